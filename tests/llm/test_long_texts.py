"""Secret scans of one text with very many secrets."""

import random
import time

import numpy as np

from cellgrid.llm import secret_scan as ss


def plain_spans(text, model, least):
    """The same by comparing each candidate with each base span."""
    spans = ss.base_spans(text)
    added = [
        (m.start(), 3, m.end()) for m in ss.CANDIDATE.finditer(text)
        if not any(s < m.end() and m.start() < e for s, _, e in spans) and any(map(str.isalpha, m[0])) and model.ratio(m[0]) >= least
    ]
    return sorted(spans + added)


def plain_blank(text, spans):
    marks = list(text)
    for start, _, end in spans:
        marks[start:end] = " " * (end - start)
    return "".join(marks)


def some_text(rng, n):
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    pieces = [lambda: hexes(32), lambda: f"token={hexes(30)}", lambda: "AKIA" + hexes(20).upper(), lambda: "getUserAccountInformation", lambda: "wörd",
              lambda: f"secret: {hexes(5)}x{hexes(30)}", lambda: f"x{hexes(28)}-KEY_{hexes(9)}", lambda: "9" * 20]
    return " ".join(rng.choice(pieces)() for _ in range(n))


def test_one_walk_finds_what_all_comparisons_find():
    rng = random.Random(4)
    model = ss.MarkovModel(np.random.default_rng(1).normal(size=(ss.STATES, ss.STATES)))
    for _ in range(40):
        text = some_text(rng, 60)
        spans = ss.all_spans(text, model, 0.0)
        assert spans == plain_spans(text, model, 0.0)
        assert ss._blank(text, ss.base_spans(text)) == plain_blank(text, ss.base_spans(text))


def test_five_megabytes_of_secrets():
    text = some_text(random.Random(5), 180_000)
    assert len(text) > 5_000_000
    model = ss.MarkovModel(np.zeros((ss.STATES, ss.STATES)))
    began = time.time()
    spans = ss.all_spans(text, model, 12.0)
    assert len(ss._blank(text, spans)) == len(text) and len(spans) > 50_000
    assert time.time() - began < 30
