"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_batches, stored
from cellgrid.llm.decontaminate import keyed

WINDOW = 32  # bytes that decide about a cut
CUT_BITS = 4  # one place in 16 is a cut
LEAST, MOST = 16, 256  # bytes of a chunk
MIN_BYTES = 128  # of neighbouring repeated chunks that are removed
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
BLOCK = 1 << 22
SIZE_BITS = 9  # a chunk's start and size share one number, for every row of them is shuffled


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last ``WINDOW`` bytes, by doubling the reach of sums."""
    total = GEAR[data]
    reach = 1
    while reach < WINDOW:
        wider = total.copy()
        wider[reach:] += total[:-reach] << np.uint32(reach)
        total, reach = wider, 2 * reach
    return total


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of ``text``; a cut never splits a UTF-8 character."""
    data = np.frombuffer(text, np.uint8)
    places = []
    for at in range(0, len(data), BLOCK):
        low = max(0, at - WINDOW)
        part = data[low : at + BLOCK + 1]
        ends = np.flatnonzero(gear_hashes(part)[:-1] >> np.uint32(32 - CUT_BITS) == 0) + 1
        ends = ends[(part[ends] & 0xC0) != 0x80] + low
        places += ends[(ends > at) & (ends <= at + BLOCK)].tolist()
    out, last = [], 0
    for place in [*places, len(data)]:
        while place - last > MOST:
            end = last + MOST
            while end > last + MOST - 4 and data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(end)
            last = end
        if place - last >= LEAST or place == len(data) > last:
            out.append(place)
            last = place
    return out


def _chunks(text: str) -> tuple[list[int], list[int], list[int]]:
    """Digests (signed), starts and ends of the chunks of a text."""
    data = text.encode("utf-8", "surrogatepass")
    ends = cuts(data)
    starts = [0, *ends][:-1]
    digest = xxhash.xxh3_64_digest
    joined = b"".join([digest(data[a:b]) for a, b in zip(starts, ends)])
    return np.frombuffer(joined, ">i8").tolist(), starts, ends


def _repeated(rows: DataFrame) -> DataFrame:
    """Digests of chunks that occur twice or more, counted per batch before they are shuffled."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        digests: list[int] = []
        for text in batch.column("text").to_pylist():
            digests += _chunks(text)[0]
        digest, n = np.unique(np.array(digests, np.int64), return_counts=True)
        return {"digest": digest, "n": n}

    counted = map_batches(rows.select("text"), run, "digest long, n long", sliced=True).groupBy("digest").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("digest")


def _places(rows: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        columns: dict[str, list] = {c: [] for c in ("digest", "k1", "k2", "chunk")}
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
            digests, starts, ends = _chunks(text)
            columns["digest"] += digests
            columns["chunk"] += [(a << SIZE_BITS) + b - a for a, b in zip(starts, ends)]
            columns["k1"] += [k1] * len(digests)
            columns["k2"] += [k2] * len(digests)
        return columns

    return map_batches(rows, run, "digest long, k1 long, k2 long, chunk long", sliced=True)


def _size(chunk: int) -> int:
    return chunk & ((1 << SIZE_BITS) - 1)


def _runs(later: list[int] | None, least: int) -> list[list[int]]:
    """Neighbouring chunks as runs of at least ``least`` bytes."""
    runs: list[list[int]] = []
    for chunk in sorted(later or ()):
        start = chunk >> SIZE_BITS
        end = start + _size(chunk)
        if runs and runs[-1][1] == start:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    return [run for run in runs if run[1] - run[0] >= least]


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_repeated, n_removed, n_spans, kept, removed)`` of each row of ``docs``.

    A chunk stays where it occurs first, in order of document id, then text hash, then place;
    later occurrences are removed where neighbouring ones have at least ``min_bytes``
    together.  ``n_repeated`` counts the bytes of later occurrences, removed or not, and
    ``removed`` holds the removed byte ranges.  Rows equal in id and text are one document and
    get equal results.  A null or empty text has no chunks; an empty table gives no rows;
    other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    texts_only = rows.select("k1", "k2", "text")
    found = stored(_places(texts_only).join(_repeated(rows), "digest"), "chunk-dedup")
    first = found.groupBy("digest").agg(F.min(F.struct("k1", "k2", "chunk")).alias("first"))
    later = found.join(first, "digest").where(F.struct("k1", "k2", "chunk") != F.col("first"))
    by_text = later.groupBy("k1", "k2").agg(F.collect_set("chunk").alias("later"))
    marked = rows.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "later")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_repeated", "n_removed", "n_spans", "kept", "removed")}
        for text, later in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            runs = _runs(later, min_bytes)
            borders = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(borders[::2], borders[1::2]))
            row = (len(data), sum(map(_size, later or ())), len(data) - len(kept), len(runs), kept.decode(),
                   [{"start": a, "end": b} for a, b in runs])
            for name, value in zip(columns, row):
                columns[name].append(value)
        return columns | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, kept string, removed array<struct<start: long, end: long>>"
    return map_batches(marked, run, schema, sliced=True)
