"""Secrets: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_batches, small_batches, texts

# The base rules, and the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more are the same runs as of 1 or more, filtered
IDENTIFIER = re.compile(r"[A-Za-z0-9_+/=-]{8,}")
CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{16,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"
STATES = len(ALPHABET) + 1  # state 0: outside a string
CODES = np.zeros(256, np.int64)
CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points of the base rules' matches, leftmost per kind."""
    spans = []
    if _may_assign(text):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _may_assign(text: str) -> bool:
    lower = text.encode("utf-8", "surrogatepass").lower()
    return any(word in lower for word in ASSIGN_WORDS)


def _blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with the spans, sorted by start, as spaces; in one pass."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            start = max(start, at)
            parts += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*parts, text[at:]])


def _values(text: str, spans: list[tuple[int, int, int]]) -> Iterator[str]:
    """The random strings themselves: the value of an assignment, a key, a digest."""
    for start, kind, end in spans:
        part = text[start:end]
        yield ASSIGN.fullmatch(part)[2] if kind == 0 else part


def _transitions(strings: list[str]) -> np.ndarray:
    """Counts of neighbouring states over all strings, their borders included."""
    codes = CODES[np.frombuffer("\n".join(["", *strings, ""]).encode("ascii", "replace"), np.uint8)]
    pairs = codes[:-1] * STATES + codes[1:]
    return np.bincount(pairs, minlength=STATES * STATES)


@dataclass(frozen=True)
class MarkovModel:
    """Log ratio of each transition: random string against ordinary identifier."""

    log_ratio: np.ndarray

    def ratio(self, string: str) -> float:
        codes = CODES[np.frombuffer(string.encode("ascii"), np.uint8)]
        path = np.concatenate([[0], codes, [0]])
        return float(self.log_ratio[path[:-1], path[1:]].sum())


def all_spans(text: str, model: MarkovModel, min_ratio: float) -> list[tuple[int, int, int]]:
    """Base spans and the strings the model takes for random, sorted by start, then kind.

    Base spans and candidates are both in order, so they are walked once together.
    """
    spans = base_spans(text)
    added, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][2])
            k += 1
        if reach > start or not any(map(str.isalpha, m[0])):
            continue
        if model.ratio(m[0]) >= min_ratio:
            added.append((start, 3, end))
    return sorted(spans + added)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, float] = (STATES, 8.0)
) -> MarkovModel:
    """Both models from all rows: values of base matches are the sample labelled random, other
    strings of eight or more identifier characters the sample labelled ordinary.

    Counts are added up per batch and then grouped, so what reaches the driver is at most two
    tables of 68 by 68 whatever the input.  The transitions of a state get ``weights`` more counts
    (random, ordinary), spread evenly: a random string may go anywhere, an identifier rarely
    goes where none has gone.  Without any string a model is uniform.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        random, ordinary = [], np.zeros(STATES * STATES, np.int64)
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            random += _values(text, spans)
            ordinary += _transitions(IDENTIFIER.findall(_blank(text, spans)))
        columns: dict[str, list] = {"model": [], "pair": [], "n": []}
        for model, counts in enumerate((_transitions(random), ordinary)):
            seen = np.flatnonzero(counts)
            columns["model"] += [model] * len(seen)
            columns["pair"] += seen.tolist()
            columns["n"] += counts[seen].tolist()
        return columns

    counts = map_batches(texts(docs, id_col, text_col), run, "model int, pair int, n long")
    tables = np.zeros((2, STATES, STATES))
    for row in counts.groupBy("model", "pair").agg(F.sum("n").alias("n")).collect():
        tables[row.model].flat[row.pair] = row.n
    tables[:, 0, 0] = 0
    tables += np.array(weights)[:, None, None] / STATES
    logs = np.log(tables / tables.sum(axis=2, keepdims=True))
    return MarkovModel(logs[0] - logs[1])


def scan(
    docs: DataFrame, model: MarkovModel, min_ratio: float = 12.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, spans)`` of each row; ``spans`` is an array of ``(kind, start, end)`` in code points.

    The base rules' matches always stay.  A string of 16 or more identifier characters that
    overlaps none of them, and is not a bare number or word sign, is added as ``markov`` if
    its log-likelihood ratio is at least ``min_ratio``.  Spans are sorted by start, then kind.
    A null or empty text has none; repeated rows and null ids each give their own row.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [all_spans(text, model, min_ratio) for text in batch.column("text").to_pylist()]
        spans = [[{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in row] for row in found]
        return {"doc_id": batch.column("doc_id"), "spans": spans}

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return map_batches(texts(docs, id_col, text_col), run, schema)


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of each row of ``scan``."""
    base = F.filter("spans", lambda s: s["kind"] != "markov")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans")
    )


def redact(
    docs: DataFrame, model: MarkovModel, mask: str = "<SECRET>", text_col: str = "text", min_ratio: float = 12.0
) -> DataFrame:
    """``docs`` with the text of each secret replaced by ``mask``; overlapping spans become one mask.

    All columns stay as they are but the text, and the character count where the column
    ``n_chars`` holds one.  A null text stays null.
    """
    small_batches(docs.sparkSession)

    def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, at = [], 0
        for start, _, end in spans:
            if start >= at:
                parts += [text[at:start], mask]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda text: masked(text, all_spans(text, model, min_ratio)), na_action="ignore")

    cleaned = docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
    return cleaned.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else cleaned
