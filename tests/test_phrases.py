"""The automaton against a search for each phrase, and both ways against each other."""

import random
import re

import pytest

from cellgrid.operators import phrases


def plain(text, names):
    words = lambda t: " ".join(re.sub(r"[\W_]+", " ", t.lower()).split())
    clean = sorted({words(p) for p in names if p and words(p)}, key=lambda p: (-len(p), p))
    return None if text is None else next((p for p in clean if f" {p} " in f" {words(text)} "), None)


@pytest.mark.parametrize("max_rows", [phrases.PHRASE_ROWS, 0])
def test_longest_phrase(spark, max_rows):
    """Phrases that are parts, ends and beginnings of each other, from few words."""
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice(["a", "b", "c", "dd", "Smog", "pm2.5"]) for _ in range(n))
    names = list({some(rng.randrange(1, 6)) for _ in range(60)}) + ["A  B", "--", "", None, "b--a"]
    rows = [(i, some(rng.randrange(0, 9)), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (902, "?!", "x"), (0, "a b", "x"), (0, "a b", "x")]
    texts = spark.createDataFrame(rows, "id long, text string, phrase string")
    table = spark.createDataFrame([(p,) for p in names], "phrase string")
    out = phrases.tag_phrases(texts, table, max_rows=max_rows)
    assert out.columns == ["id", "text", "phrase", "found"]
    got = sorted(((r.id, r.text, r.found) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, plain(t, names)) for i, t, _ in rows), key=repr)
    assert {r.found for r in phrases.tag_phrases(texts, table.limit(0), max_rows=max_rows - 1 if not max_rows else max_rows).collect()} == {None}


def test_ten_thousand_phrases_in_one_pass():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(300)}"
    names = sorted({" ".join(word() for _ in range(rng.randrange(2, 6))) for _ in range(10_000)}, key=lambda p: (-len(p), p))
    machine = phrases.automaton([p.split(" ") for p in names])
    found = 0
    for _ in range(100):
        text = " ".join(word() for _ in range(300))
        rank = phrases.first_ranked(text.split(" "), *machine)
        assert rank == next((k for k, p in enumerate(names) if f" {p} " in f" {text} "), len(names))
        found += rank < len(names)
    assert found > 50
