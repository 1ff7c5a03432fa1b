"""Trained models against plain versions of their definitions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from math import exp, log, log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.llm import secret_scan, site_quality, toxicity
from text_samples import sentence

D = 0.75


# --- Kneser-Ney ---------------------------------------------------------------------
class PlainSpelling:
    """Two interpolated models of characters over one shared model of continuation counts."""

    def __init__(self, rows):
        self.count = {True: Counter(), False: Counter()}
        for text, toxic in rows:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                spelled = "\x02" + word + "\x03"
                for end in range(2, len(spelled) + 1):
                    self.count[toxic][spelled[max(0, end - 5) : end]] += 1
        self.seen = set(self.count[True]) | set(self.count[False])
        # at each length, in how many different grams that are one character longer a gram ends
        self.continued = {}
        longer = {g for g in self.seen if len(g) == 5}
        for size in (4, 3, 2, 1):
            self.continued[size] = Counter(g[1:] for g in longer)
            longer = set(self.continued[size]) | {g for g in self.seen if len(g) == size and g[0] == "\x02"}
        self.shared = cache(self.shared)

    def shared(self, gram):
        if not gram:
            return 1 / len(self.continued[1])
        level = self.continued[len(gram)]
        beside = [n for g, n in level.items() if g[:-1] == gram[:-1]]
        return (max(level[gram] - D, 0) + D * len(beside) * self.shared(gram[1:])) / sum(beside)

    def probability(self, toxic, gram):
        beside = [n for g, n in self.count[toxic].items() if g[:-1] == gram[:-1]]
        if not beside:
            return self.shared(gram[1:])
        return (max(self.count[toxic][gram] - D, 0) + D * len(beside) * self.shared(gram[1:])) / sum(beside)

    def left(self, toxic, context):
        beside = [n for g, n in self.count[toxic].items() if g[:-1] == context]
        return D * len(beside) / sum(beside) if beside else 1.0


def test_spelling_models_are_kneser_ney(spark):
    rng = random.Random(11)
    stems = ["spark", "sparse", "park", "a", "an", "añb", "日本", "toad", "toady", "road"]
    rows = [(" ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randrange(9))), k % 3 == 0) for k in range(60)]
    rows += [("onlytoxic Onlytoxic", True), ("onlyordinary 12 _", False), ("", True)]
    given = spark.createDataFrame(rows, "text string, toxic boolean").repartition(3)
    grams = toxicity._grams(toxicity._word_counts(given))
    plain = PlainSpelling(rows)
    assert {r.gram: (r.toxic, r.ordinary) for r in grams.collect()} == {g: (plain.count[True][g], plain.count[False][g]) for g in plain.seen}
    got = {(r.kind, r.key): r.ratio for r in toxicity.log_ratios(grams, D).collect()}
    want = {(0, g): log(plain.probability(True, g) / plain.probability(False, g)) for g in plain.seen}
    want |= {(1, c): log(plain.left(True, c) / plain.left(False, c)) for c in {g[:-1] for g in plain.seen}}
    assert got == pytest.approx(want, abs=1e-9)
    for toxic in (True, False):  # what follows a context sums to one, unseen characters aside
        after = [g for g in plain.seen if g[:-1] == "\x02"]
        unseen = sum(plain.shared(g) for g in plain.continued[1] if "\x02" + g not in plain.seen)
        total = sum(plain.probability(toxic, g) for g in after) + plain.left(toxic, "\x02") * unseen
        assert total == pytest.approx(1, abs=1e-9)


# --- empirical Bayes ----------------------------------------------------------------
def plain_bins(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, chars = len(words), sum(map(len, words))
    letters, capitals = sum(c.isalpha() for c in text or ""), sum(c.isupper() for c in text or "")
    share = lambda part, whole: min(int(part / whole * 16) if whole else 0, 15)
    marks = sum((text or "").count(c) for c in "!?")
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return (share(symbols, n), share(capitals, letters), share(marks, n), share(len(set(words)), n), min(int(log2(n + 1)), 15), min(chars // n if n else 0, 15))


def plain_shrink(groups, prior):
    """``groups``: key to (good, n); ``prior``: key to its mean above."""
    total, squares = sum(n for _, n in groups.values()), sum(n * n for _, n in groups.values())
    spread = sum(n * (good / n - prior[k]) ** 2 for k, (good, n) in groups.items())
    within = [prior[k] * (1 - prior[k]) for k in groups]
    scale = total - squares / total
    between = (spread - sum(within)) / scale if scale else None
    strength = 1.0 if between is None else min(max(sum(within) / len(within) / max(between, 1e-6) - 1, 1.0), 1e6)
    return {k: (good + strength * prior[k]) / (n + strength) for k, (good, n) in groups.items()}


def test_sites_are_shrunk_and_added_to_the_evidence(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(400):
        host = rng.choice(["h0", "h1", "h2", "rare"] if i % 40 == 0 else ["h0", "h1", "h2"])
        good = rng.random() < {"h0": 0.2, "h1": 0.5, "h2": 0.9, "rare": 0.5}[host]
        text = sentence(rng, rng.randrange(1, 60))
        docs.append((i, text if good else text.upper() + " !! ##", host, rng.choice("pq")))
        if i % 5:
            labels.append((i, int(good)))
    docs += [(900, None, "h0", "p"), (901, "", None, None), (902, "new site", "h9", "p"), (2, "again", "h1", "q"), (None, "no id", "h1", "p")]
    labels += [(3, 0), (3, 1), (None, 1), (7777, 1), (4, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, host string, path string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    few = site_quality.labelled(table, known)
    measure = lambda rows: site_quality.measured(rows, rows["host"], rows["path"])
    got = site_quality.score(measure(table), site_quality.train(measure(few), known)).collect()

    quality = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            quality[i].append(q)
    rows = [(i, plain_bins(t), h or "", f"{h or ''}/{p or ''}") for i, t, h, p in docs]
    seen = [(min(quality[i]) > 0, bins, host, path) for i, bins, host, path in rows if i in quality]
    assert few.count() == len(seen) and few.columns == table.columns
    n, good = len(seen), sum(g for g, *_ in seen)
    prior = (good + 1) / (n + 2)

    def evidence(feature, value):
        own = [g for g, bins, *_ in seen if bins[feature] == value]
        if not own:
            return 0.0
        return max(-6.0, min(6.0, log(((sum(own) + 0.5) / (good + 8)) / ((len(own) - sum(own) + 0.5) / (n - good + 8)))))

    def grouped(place):
        groups = defaultdict(lambda: (0, 0))
        for row in seen:
            g, c = groups[row[place]]
            groups[row[place]] = g + row[0], c + 1
        return dict(groups)

    hosts = plain_shrink(grouped(2), defaultdict(lambda: prior))
    paths = plain_shrink(grouped(3), {path: hosts[host] for _, _, host, path in seen})
    want = Counter()
    for i, bins, host, path in rows:
        site = paths.get(path, hosts.get(host, prior))
        said = sum(evidence(k, value) for k, value in enumerate(bins))
        want[(i, round(said, 9), round(site, 9), round(1 / (1 + exp(-(said + log(site / (1 - site))))), 9))] += 1
    assert Counter((r.doc_id, round(r.evidence, 9), round(r.site, 9), round(r.score, 9)) for r in got) == want


# --- Markov models ------------------------------------------------------------------
def test_transitions_of_random_and_ordinary_strings(spark):
    rng = random.Random(13)
    key = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    made = [f"{sentence(rng, 8)} token = {key(20)} some_long_identifier {key(32)} getUserAccount" for _ in range(30)]
    made += ["password: hunter22 and AKIA" + "QWERTYUIOPASDFGHJKLZ", "", None, "short", made[0]]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    model = secret_scan.train(docs)

    alphabet = [None, *"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"]
    random_strings, ordinary_strings = [], []
    for text in made:
        left = list(text or "")
        for pattern, group, least in (
            (r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24),
        ):
            for m in re.finditer(pattern, text or ""):
                if len(m[group]) >= least:
                    random_strings.append(m[group])
                    left[m.start() : m.end()] = " " * (m.end() - m.start())
        ordinary_strings += re.findall(r"[A-Za-z0-9_+/=-]{8,}", "".join(left))
    tables = []
    for strings, weight in ((random_strings, len(alphabet)), (ordinary_strings, 8.0)):
        counts = Counter()
        for s in strings:
            path = [None, *[c if c in alphabet else None for c in s], None]
            counts.update((a, b) for a, b in zip(path, path[1:]) if (a, b) != (None, None))
        tables.append((counts, weight / len(alphabet)))

    def log_p(table, a, b):
        counts, extra = table
        total = sum(counts[(a, c)] for c in alphabet) + extra * len(alphabet)
        return log((counts[(a, b)] + extra) / total)

    want = [[log_p(tables[0], a, b) - log_p(tables[1], a, b) for b in alphabet] for a in alphabet]
    assert model.log_ratio == pytest.approx(np.array(want), abs=1e-9)
    assert model.ratio("aZ9_") == pytest.approx(sum(want[alphabet.index(a)][alphabet.index(b)] for a, b in zip([None, *"aZ9_"], [*"aZ9_", None])), abs=1e-9)
    assert docs.where(F.col("text").contains("AKIA")).count() == 1
