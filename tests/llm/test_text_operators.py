"""Decontamination, tokens, secrets, chat, rules, toxicity and quality against plain versions."""

import hashlib
import random
import re
import string
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from text_samples import sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellgrid.llm import bpe, chat, decontaminate, quality_rules, secret_scan, site_quality, toxicity
from cellgrid.llm.common import texts, tokenizer_path


# --- decontamination ----------------------------------------------------------------
def plain_overlap(text, item, least=12):
    words = lambda t: decontaminate.WORD.findall((t or "").lower())
    a, b = words(text), words(item)
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= shift + k < len(a) and a[shift + k] == w for k, w in enumerate(b)]
        for i in range(len(b)):
            for j in range(len(b), i + best, -1):
                if 0 <= shift + i and shift + j <= len(a) and 5 * sum(same[i:j]) >= 4 * (j - i):
                    best = max(best, j - i)
    return best if len(b) >= 5 and best >= min(least, len(b)) else 0


def test_overlaps_match_brute_force(spark, no_docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(4))
    items = [[word() for _ in range(n)] for n in (40, 15, 12, 7, 5, 3)] + [[]]
    rows, want = [], {}
    for doc in range(60):
        filler = [word() for _ in range(rng.randrange(5, 80))]
        item = rng.choice(items)
        piece = [word() if rng.random() < rng.choice([0, 0.1]) else w for w in item]
        if rng.random() < 0.3:
            piece = piece[: len(piece) // 2]
        at = rng.randrange(len(filler))
        rows.append((doc, ", ".join(filler[:at] + [w.upper() for w in piece] + filler[at:])))
    rows += [(None, " ".join(items[0])), (100, None), (101, ""), (0, rows[0][1])]
    tests = [(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("x")).withColumn("item_id", F.lit("y"))
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_tokens) for r in decontaminate.overlaps(docs, bench).collect())
    want = Counter((i, k, n) for i, t in rows for k, x in tests if (n := plain_overlap(t, x)))
    assert got == want and len(want) > 20
    kept = decontaminate.clean_only(docs, bench)
    assert kept.columns == docs.columns
    dirty = {i for i, _, _ in want}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in dirty)
    assert decontaminate.overlaps(no_docs, bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_masks_leave_a_placement_for_all_substitutions():
    reads = [(len(m), [k for k, c in enumerate(m) if c == "1"]) for m in decontaminate.MASKS]
    for n in range(12, 25):
        placed = np.array([sum(1 << (at + k) for k in read) for size, read in reads for at in range(n - size + 1)])
        changed = np.array([sum(1 << k for k in at) for at in combinations(range(n), n // 5)])
        assert ((changed[:, None] & placed) == 0).any(axis=1).all(), n


def test_overlaps_with_one_word_in_five_changed(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    items = [[word() for _ in range(n)] for n in (12, 13, 15, 16, 20, 24, 40)]
    rows = []
    for doc in range(140):
        piece = list(items[doc % len(items)])
        for k in rng.sample(range(len(piece)), len(piece) // 5):
            piece[k] = word()
        rows.append((doc, " ".join([*(word() for _ in range(rng.randrange(9))), *piece, *(word() for _ in range(5))])))
    for doc, at in ((900, (0, 3)), (901, (2, 3))):
        rows.append((doc, " ".join(word() if k in at else w for k, w in enumerate(items[0]))))
    tests = [(k, " ".join(x)) for k, x in enumerate(items)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame(tests, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_tokens) for r in found.collect()}
    assert got == {(i, k, n) for i, t in rows for k, x in tests if (n := plain_overlap(t, x))} and len(got) == len(rows)


def test_short_items_and_texts_without_spaces(spark):
    """Items of 1 to 11 words, one word in five changed, and of ideographs; against each shift of each pair."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    sign = lambda: chr(rng.randrange(0x4E00, 0x9000))
    items = {n: [word() for _ in range(n)] for n in range(1, 12)}
    signs = {50 + n: [sign() for _ in range(n)] for n in (4, 11, 30)}
    rows = []
    for key, item in [*items.items(), *signs.items()]:
        new, between = (sign, "") if key > 50 else (word, " ")
        for k, changes in enumerate((0, len(item) // 5, len(item) // 5, len(item) // 5 + 1)):
            at = set(rng.sample(range(len(item)), min(changes, len(item))))
            piece = [new() if j in at else w for j, w in enumerate(item)]
            rows.append((100 * key + k, between.join(piece)))
            rows.append((100 * key + 10 + k, between.join([new(), *piece, *(new() for _ in range(6))])))
    tests = [(k, " ".join(x)) for k, x in items.items()] + [(k, "".join(x)) for k, x in signs.items()] + [(0, "--")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame(tests, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_tokens) for r in found.collect()}

    def tokens(text):
        return [c for part in text.split() for c in ([part] if part.isascii() else part)]

    def best(a, b):
        size = 0
        for shift in range(-len(b) + 1, len(a)):
            same = [0 <= shift + k < len(a) and a[shift + k] == w for k, w in enumerate(b)]
            stretches = [(i, j) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if 0 <= shift + i and shift + j <= len(a)]
            size = max([size, *(j - i for i, j in stretches if 5 * sum(same[i:j]) >= 4 * (j - i))])
        return size if size >= min(12, len(b)) and (len(b) > 4 or len(a) == len(b)) else 0

    want = {(i, k, n) for i, t in rows for k, x in tests if k and (n := best(tokens(t), tokens(x)))}
    assert got == want and {i // 100 for i, _, _ in want} == {*items, *signs}


def test_short_masks_ignore_every_choice_of_words():
    for n in range(1, 12):
        masks = decontaminate.short_masks(n)
        assert len(masks) <= 6 and all(5 * m.count("1") >= 2 * n for m in masks)
        for changed in combinations(range(n), n // 5):
            assert any(all(m[k] == "0" for k in changed) for m in masks), (n, changed)


def test_the_filter_grows_with_the_seeds():
    assert [decontaminate.filter_bits(n) for n in (0, 1_000, 100_000, 10**6, 10**9)] == [20, 20, 22, 25, 28]


def test_sample_of_rules_is_bounded(spark):
    """One text that holds nearly all rows is one row of the sample."""
    rows = spark.range(5_000).selectExpr("id AS doc_id", "if(id % 100 = 0, concat('text ', id), 'the same text again') AS text")
    drawn = []
    real = quality_rules.stored
    quality_rules.stored = lambda df, name: drawn.append(real(df, name)) or drawn[-1]
    try:
        quality_rules.plan(rows, sample_rows=10)
        quality_rules.plan(rows, sample_rows=5_000)
    finally:
        quality_rules.stored = real
    assert drawn[0].count() <= 20 and drawn[1].count() == 51


def test_longest_overlap_is_the_longest():
    rng = random.Random(4)
    for _ in range(300):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randrange(0, 25))], bool)
        best = max((j - i for i in range(len(same) + 1) for j in range(i, len(same) + 1) if 5 * same[i:j].sum() >= 4 * (j - i)), default=0)
        start, size = decontaminate.longest_overlap(same)
        assert size == best and 5 * same[start : start + size].sum() >= 4 * size


# --- tokens -------------------------------------------------------------------------
def test_round_trip_matches_the_tokenizers_library(edges, edge_rows, no_docs):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc, text in edge_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(edges).collect())) == want
    assert bpe.round_trip(no_docs).count() == 0


def test_windows_and_slices_change_nothing():
    tokenizer, vocabulary = Tokenizer.from_file(tokenizer_path()), bpe.Vocabulary.read()
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    encoder.window = vocabulary.lookahead + vocabulary.longest
    rng = random.Random(6)
    for alphabet in ("ab", "-=_ ", "theingou", "0123456789", "<|endoftext|> \n", "aé日🙂 '"):
        text = "".join(rng.choice(alphabet) for _ in range(4000))
        ids = np.frombuffer(b"".join(encoder.stream(text)), "<u4")
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert "".join(decoder.stream(ids.tobytes())) == text
    ids = [rng.randrange(50257) for _ in range(300)]
    assert "".join(decoder.stream(np.array(ids, "<u4").tobytes())) == tokenizer.decode(ids, skip_special_tokens=False)


# --- secrets ------------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) > 5]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 19]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(8)
    code = lambda n, a=string.hexdigits[:16]: "".join(rng.choice(a) for _ in range(n))
    rows = []
    for k in range(80):
        secret = rng.choice([f'ToKen = "{code(30)}"', f"api_key:{code(7)}", f"password=ab", "AKIA" + code(16, string.ascii_uppercase + string.digits), "AKIA12", code(40), code(20), "ſecret=abcdefgh"])
        rows.append((k, f"日 {sentence(rng, 30)} {secret} {sentence(rng, 30)} counterproductively_measured_values"))
    random_key = "q7Xk29vLpZ04mWn8RtBd5Ys"
    names = "HTTPServerName RequestCount2 maxRetries3 API_VERSION_1 UserProfileView parseJSONValue LOG_LEVEL_DEBUG"
    rows += [(100 + k, names) for k in range(20)]
    rows += [(90, f"see {random_key} here"), (91, None), (92, ""), (None, rows[0][1]), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")), rows, random_key


def test_base_spans_match_the_rules_and_the_model_adds(leaky, no_docs):
    docs, rows, key = leaky
    model = secret_scan.train(docs.where("doc_id != 90"))
    found = secret_scan.scan(docs, model).collect()
    base = Counter((r.doc_id, ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans if s["kind"] != "markov")) for r in found)
    assert base == Counter((i, plain_base(t or "")) for i, t in rows)
    added = [(r.doc_id, s["start"], s["end"]) for r in found for s in r.spans if s["kind"] == "markov"]
    assert (90, 4, 4 + len(key)) in added
    assert model.ratio("counterproductively_measured_values") < 0 < model.ratio(key)
    digest = {r.doc_id: r.base_sha256 for r in secret_scan.summary(secret_scan.scan(docs, model)).collect()}
    assert digest[3] == hashlib.sha256(plain_base(rows[3][1]).encode()).hexdigest()
    assert secret_scan.scan(no_docs, secret_scan.train(no_docs)).count() == 0


def test_redaction_keeps_everything_else(leaky):
    docs, rows, key = leaky
    model = secret_scan.train(docs.where("doc_id != 90"))
    out = secret_scan.redact(docs, model)
    assert out.columns == docs.columns
    cleaned = {r.doc_id: r.text for r in out.collect()}
    assert cleaned[90] == "see <SECRET> here" and cleaned[91] is None and cleaned[92] == ""
    assert all(not plain_base(t or "") for t in cleaned.values())


# --- chat ---------------------------------------------------------------------------
def test_transcripts_read_back_exactly(spark):
    rng = random.Random(3)
    odd = ["<|im_end|>", "<\\|x", "<\\\\|", "\\", "日本", "", "a\nb", "<|im_start|>assistant ok", None, "<", "|"]
    rows = []
    for conv in [*range(1, 30), None]:
        for turn in range(rng.randrange(1, 9)):
            text = None if rng.random() < 0.1 else "".join(x or "" for x in rng.choices(odd, k=rng.randrange(5)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "odd\nrole\\n"]), text))
    rows += [(40, t, "assistant", "x" * 5000) for t in range(2500)] + [rows[0], (1, None, None, "no turn")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.transcripts(turns).cache()
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    assert made.where("conv_id = 40").count() > 1
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (low(r[0]), (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or "")))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in mine)
        learn = "".join(text or "" for _, role, text in mine if role == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learn), hashlib.sha256(learn.encode()).hexdigest())
    assert not got
    assert sum(len(r.formatted) for r in made.collect()) > 0
    assert chat.read_back(chat.transcripts(turns.limit(0))).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("<|\\ a\n") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


# --- rules --------------------------------------------------------------------------
def plain_measures(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_measures_match_plain_ones(spark, edges, edge_rows, no_docs):
    order = quality_rules.plan(edges)
    assert {e.rule.name for e in order} == {r.name for r in quality_rules.RULES}
    rows = quality_rules.judge(edges, order).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *plain_measures(t)) for i, t in edge_rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in rows)
    assert quality_rules.judge(no_docs, quality_rules.plan(no_docs)).count() == 0


def test_any_order_gives_the_same_verdict(spark):
    rng = random.Random(2)
    good = " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(80))
    shown = [good, good.upper(), good.replace(" ", " ** "), "\n".join([good[:50], good[50:]] * 2), good.replace(" ", "") * 60]
    docs = spark.createDataFrame(list(enumerate(shown)), "doc_id long, text string")
    order = quality_rules.plan(docs)
    verdicts = [sorted((r.doc_id, r.kept) for r in quality_rules.judge(docs, o).collect()) for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1] and [k for _, k in verdicts[0]][:3] == [True, False, False]


# --- toxicity and quality -----------------------------------------------------------
def test_toxic_words_are_learned_and_nothing_else_counts(spark, no_docs):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        words = sentence(rng, rng.choice([30, 200])).split()
        toxic = k % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), "grumbl" + rng.choice(["ed", "ing", "y", "ous"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "grumbling grumblous"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(texts(docs), known))
    scored = toxicity.score(docs, model).join(known.where("toxic is not null").distinct(), "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    every = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(every) == 403 and every[None].predicted == 1 and not every[None].held_out
    assert every[1000].score == every[1001].score < 0.3
    kept = toxicity.ordinary_only(docs, model)
    assert kept.columns == docs.columns and {1000, 1001} <= {r.doc_id for r in kept.collect()}
    shuffled = toxicity.training_rows(texts(docs), known, max_rows=0)
    same = ["doc_id", "toxic", "calibrates"]
    assert sorted(shuffled.select(*same).collect()) == sorted(toxicity.training_rows(texts(docs), known).select(*same).collect())
    nothing = toxicity.train(toxicity.training_rows(texts(no_docs), known.limit(0)))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}


def labelled(spark, rng, n):
    """Documents of invented words, every fourth with a toxic one, and their labels."""
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = [(k, " ".join([*rng.choices(words, k=12), *(["grumbly"] if k % 4 == 0 else [])])) for k in range(n)]
    docs = spark.createDataFrame([*rows, (None, ""), (n, None), (0, rows[0][1])], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(n)], "doc_id long, toxic int")


def test_a_gram_never_takes_the_ratio_of_another(spark):
    docs, labels = labelled(spark, random.Random(3), 200)
    rows = toxicity.training_rows(texts(docs), labels)
    grams = toxicity._grams(toxicity._word_counts(rows))
    table = {(r.kind, r.key): r.ratio for r in toxicity.log_ratios(grams, 0.75).collect()}
    low = lambda gram: toxicity.xxhash.xxh64_intdigest(gram.encode(), 42) & ((1 << 22) - 1)
    taken = {low(key) for kind, key in table if kind == 0}
    rng, unseen = random.Random(4), []
    while len(unseen) < 20:  # words whose first gram no label has, but whose 22 low bits of the hash one has
        word = "".join(rng.choice("абвгдежзиклмнопрстуфхцчшщ") for _ in range(6))
        if any(low(("\x02" + word + "\x03")[max(0, e - 5) : e]) in taken for e in range(2, 9)):
            unseen.append(word)
    model = toxicity._model(toxicity.log_ratios(grams, 0.75))
    for word in [*unseen, "grumbly", "grum"]:
        spelled = f"\x02{word}\x03"
        parts = [spelled[max(0, e - 5) : e] for e in range(2, len(spelled) + 1)]
        plain = sum(table.get((0, g), table.get((1, g[:-1]), 0.0)) for g in parts) / len(parts)
        assert model.features(word)[0] == pytest.approx(plain, abs=1e-5)


def test_more_grams_than_are_broadcast_are_joined(spark, monkeypatch):
    docs, labels = labelled(spark, random.Random(5), 300)
    answers = []
    for bound in (toxicity.BROADCAST_GRAMS, 10):
        monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", bound)
        model = toxicity.train(toxicity.training_rows(texts(docs), labels))
        assert (model.tables is None) == (bound == 10)
        scored = sorted(toxicity.score(docs, model).collect(), key=str)
        kept = sorted(toxicity.ordinary_only(docs, model).collect(), key=str)
        answers.append(([r.doc_id for r in scored], [r.predicted for r in scored], kept))
        scores = [r.score for r in scored]
        answers[-1] += (scores,)
    assert answers[0][:3] == answers[1][:3] and len(answers[0][0]) == 303
    assert answers[0][3] == pytest.approx(answers[1][3], abs=1e-4)


def test_labelled_rows_beyond_the_calibration_are_counted(spark, monkeypatch):
    docs, labels = labelled(spark, random.Random(6), 300)
    rows = toxicity.training_rows(texts(docs), labels)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 20)
    seen = {}
    counts, features = toxicity._word_counts, toxicity._features
    monkeypatch.setattr(toxicity, "_word_counts", lambda x: (seen.update(counted=x), counts(x))[1])
    monkeypatch.setattr(toxicity, "_features", lambda x, m: (seen.update(calibrated=x), features(x, m))[1])
    toxicity.train(rows)
    counted, calibrated = (Counter(r.doc_id for r in seen[k].select("doc_id").collect()) for k in ("counted", "calibrated"))
    assert not counted.keys() & calibrated.keys()
    assert counted + calibrated == Counter(r.doc_id for r in rows.select("doc_id").collect())
    assert 18 <= calibrated.total() <= 20 < rows.where("calibrates").count()


def test_no_calibration_drops_nothing(spark):
    docs, labels = labelled(spark, random.Random(9), 20)
    model = toxicity.train(toxicity.training_rows(texts(docs), labels.limit(0)))
    assert toxicity.ordinary_only(docs, model).count() == docs.count() == 23
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def test_sparse_sites_are_drawn_to_their_prior(spark, no_docs):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < (0.9 if k % 3 else 0.3)
        text = sentence(rng, 60) if good or rng.random() < 0.2 else sentence(rng, 60).replace(" ", " ### ")
        rows.append((k, text, f"host{k % 3}", f"p{k % 7}", "x"))
        labels.append((k, int(good)))
    rows += [(700, None, None, None, "x"), (None, "", "host1", "new", "x"), (5, "again", "rare", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, site string, p string, mean string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    measured = site_quality.measured(docs, docs["site"], docs["p"])
    model = site_quality.train(measured, known)
    hosts = {r.host: r.mean for r in model.hosts.collect()}
    assert hosts["host0"] < 0.5 < hosts["host1"]
    got = site_quality.score(measured, model).collect()
    assert len(got) == len(rows) and all(0 < r.score < 1 for r in got)
    right = [r.keep == bool(labels[r.doc_id][1]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(right) > 0.85 * len(right)
    assert next(r for r in got if r.doc_id == 700).site == pytest.approx(model.prior)
    empty = site_quality.measured(no_docs, no_docs["source"], no_docs["lang"])
    blank = site_quality.train(empty, known)
    assert {r.score for r in site_quality.score(measured, blank).collect()} == {0.5}
