"""Removal of every byte that lies in a long string which occurs more than once.

A string of ``length`` bytes holds ``length - GRAM + 1`` grams.  Its anchor is the gram with the
smallest hash, so equal strings have equal anchors at equal places.  Neighbouring strings
with one anchor form a segment; strings can only repeat between segments of one anchor.
Segments whose anchor occurs again are dealt out by anchor.  In each shard, strings whose hash
occurs once are left out, and the rest is decided by suffix array and common prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_batches, stored, texts
from cellgrid.llm.induced import permuted_prefixes, suffix_array

GRAM = 64
BLOCK = 1 << 22  # bytes of a text that are hashed at a time
SHARD = 1 << 19  # bytes of contents that are decided together
HOT_BYTES = 1 << 20  # distinct bytes of one anchor beyond which its strings are dealt out singly
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
BREAK = 0xFF  # never a byte of UTF-8


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class Anchors:
    """Segments of a text, as ``(anchor, start, size)``; holds tables of a fixed size."""

    def __init__(self, length: int, block: int = BLOCK) -> None:
        if length < GRAM:
            raise ValueError(f"strings must have at least {GRAM} bytes")
        self.length, self.block = length, max(block, 2 * length)
        self.up = self.down = np.ones(1, np.uint64)
        self.values = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [(np.zeros(0, np.int64),) * 3]
        step = self.block - self.length + 1
        for at in range(0, max(len(data) - self.length + 1, 0), step):
            anchor, start, size = self._block(np.frombuffer(data, np.uint8)[at : at + self.block])
            parts.append((anchor, start + at, size))
        return tuple(np.concatenate(column) for column in zip(*parts))

    def hashes(self, data: np.ndarray, width: int) -> np.ndarray:
        """The hash of every ``width`` neighbouring bytes."""
        n = len(data)
        if n < width:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            size = max(n, min(self.block, 2 * len(self.up)))
            self.up, self.down = _powers(ODD, size), _powers(INVERSE, size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        found = (total[width:] - total[:-width]) * self.down[: n - width + 1]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(32)
        return found

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams = self.hashes(data, GRAM)
        keyed = grams & ~np.uint64(0xFFFFFF) | np.arange(len(grams), dtype=np.uint64)
        least = _window_minimum(keyed, self.length - GRAM + 1)
        first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
        sizes = np.diff(np.append(first, len(least))) + self.length - 1
        place = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        return grams[place].view(np.int64), first, sizes


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    ahead = np.minimum.accumulate(full.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(full.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]


def _repeated_anchors(rows: DataFrame, length: int) -> DataFrame:
    """Anchors with two or more segments; counted per batch before they are shuffled."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        anchors = Anchors(length)
        anchor, n = np.unique(np.concatenate([anchors.of(x)[0] for x in _bytes(batch)]), return_counts=True)
        return {"anchor": anchor, "n": n}

    counted = map_batches(rows.select("text"), run, "anchor long, n long")
    return counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _segments(rows: DataFrame, length: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        anchors = Anchors(length)
        found = [anchors.of(x) for x in _bytes(batch)]
        each = [len(x[0]) for x in found]
        columns = {c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), each) for c in ("k1", "k2")}
        return columns | {c: np.concatenate(x) for c, x in zip(("anchor", "start", "size"), zip(*found))}

    return map_batches(rows, run, "k1 long, k2 long, anchor long, start long, size long", sliced=True)


def _contents(joined: DataFrame) -> DataFrame:
    """One row per anchor and content of a few texts, with the places where they have it."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        made: dict[tuple[int, bytes], list] = {}
        segments = batch.column("segments")
        each = segments.value_lengths().to_pylist()
        flat = segments.flatten()
        of = zip(*(flat.field(c).to_pylist() for c in ("anchor", "start", "size")))
        for k1, k2, data, n in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), _bytes(batch), each):
            for anchor, start, size in islice(of, n):
                content = data[start : start + size]
                key = anchor, xxhash.xxh3_128_digest(content)
                made.setdefault(key, [content, []])[1].append((k1, k2, start))
        return {
            "anchor": [k[0] for k in made],
            "digest": [k[1] for k in made],
            "content": [v[0] for v in made.values()],
            "n": [len(v[1]) for v in made.values()],
            "places": [[{"k1": a, "k2": b, "start": c} for a, b, c in v[1]] for v in made.values()],
        }

    schema = "anchor long, digest binary, content binary, n long, places array<struct<k1: long, k2: long, start: long>>"
    return map_batches(joined, run, schema, sliced=True)


def repeated_starts(contents: list[bytes], length: int, anchors: Anchors | None = None) -> list[np.ndarray]:
    """For each content the starts of strings that occur again in it or in another of them.

    Stretches without a string whose hash occurs twice cannot repeat; the others are sorted.
    """
    data = np.frombuffer(b"".join(x + bytes([BREAK]) for x in contents), np.uint8)
    first = np.cumsum([0, *(len(x) + 1 for x in contents)])
    starts = np.concatenate([np.arange(a, max(a, b - length)) for a, b in zip(first[:-1], first[1:])])
    hashes = (anchors or Anchors(max(length, GRAM))).hashes(data, length)[starts]
    order = np.argsort(hashes)
    equal = np.diff(hashes[order]) == 0
    twice = np.zeros(len(starts), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    open_starts = starts[twice]
    found = np.zeros(len(data), bool)
    if len(open_starts):
        cut = np.flatnonzero(np.diff(open_starts, prepend=-2) > 1)
        low, high = open_starts[cut], np.append(open_starts[cut[1:] - 1], open_starts[-1]) + length
        text = np.concatenate([part for a, b in zip(low, high) for part in (data[a:b], [BREAK])]).astype(np.uint8)
        sizes = high - low + 1
        place = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(len(text))
        strings = np.arange(len(text)) + length <= np.repeat(np.cumsum(sizes) - 1, sizes)
        ranks = suffix_array(text, 256)
        long = permuted_prefixes(text, ranks)[ranks] >= length
        long[:-1] |= long[1:]
        again = np.zeros(len(text), bool)
        again[ranks] = long
        found[place[again & strings]] = True
    return [np.flatnonzero(found[a:b]) for a, b in zip(first[:-1], first[1:])]


def _runs(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """The bytes of strings at sorted ``starts`` as maximal runs."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first, last = np.append(starts[0], starts[gap + 1]), np.append(starts[gap], starts[-1])
    return [{"start": a, "end": b} for a, b in zip(first.tolist(), (last + length).tolist())]


def _sorted_shards(contents: DataFrame, length: int) -> DataFrame:
    """``(anchor, digest, runs)`` by the suffix array of each shard of whole anchors.

    Partitions arrive sorted by anchor and are cut into shards; a shard ends with its anchor,
    and an anchor's distinct contents have at most ``HOT_BYTES``.
    """
    schema = "anchor long, digest binary, runs array<struct<start: long, end: long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: dict[tuple[int, bytes], list] = {}
        size, last = 0, None
        anchors = Anchors(length, 4 * SHARD)
        for batch in batches:
            for anchor, digest, content, n in batch.itertuples(index=False):
                if anchor != last and size >= SHARD:
                    yield decided(shard, anchors)
                    shard, size = {}, 0
                last = anchor
                seen = shard.setdefault((anchor, bytes(digest)), [bytes(content), 0])
                size += 0 if seen[1] else len(content)
                seen[1] += n
        if shard:
            yield decided(shard, anchors)

    def decided(shard: dict[tuple[int, bytes], list], anchors: Anchors) -> pd.DataFrame:
        kinds: dict[int, int] = {}
        for anchor, _ in shard:
            kinds[anchor] = kinds.get(anchor, 0) + 1
        # a content that is alone with its anchor repeats as a whole: its anchor occurs again
        open_keys = [k for k in shard if kinds[k[0]] > 1]
        starts = dict(zip(open_keys, repeated_starts([shard[k][0] for k in open_keys], length, anchors))) if open_keys else {}
        runs = [
            [{"start": 0, "end": len(content)}] if n > 1 else _runs(starts.get(key, np.zeros(0, np.int64)), length)
            for key, (content, n) in shard.items()
        ]
        return pd.DataFrame({"anchor": [k[0] for k in shard], "digest": [k[1] for k in shard], "runs": runs})

    dealt = contents.select("anchor", "digest", "content", "n").repartition("anchor").sortWithinPartitions("anchor", "digest")
    return dealt.mapInPandas(run, schema)


def _single_strings(contents: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more distinct bytes than one shard takes: every string of theirs
    is counted by itself, so that no anchor is one task."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        for anchor, digest, content, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "content", "n"))):
            starts = range(len(content) - length + 1)
            strings = [xxhash.xxh3_128_digest(content[a : a + length]) for a in starts]
            size = len(strings)
            yield {"anchor": [anchor] * size, "digest": [digest] * size, "n": [n] * size, "start": starts, "string": strings}

    once = contents.groupBy("anchor", "digest").agg(F.max("content").alias("content"), F.sum("n").alias("n"))
    strings = map_batches(once, run, "anchor long, digest binary, n long, start long, string binary")
    again = strings.groupBy("string").agg(F.sum("n").alias("m")).where("m > 1").select("string")

    @F.pandas_udf("array<struct<start: long, end: long>>")
    def runs(starts: pd.Series) -> pd.Series:
        return starts.map(lambda x: _runs(np.sort(x), length))

    found = strings.join(again, "string").groupBy("anchor", "digest").agg(F.collect_list("start").alias("starts"))
    return found.select("anchor", "digest", runs("starts").alias("runs"))


def repeated_spans(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """Texts with the spans (in bytes of UTF-8) that repeated strings of ``length`` bytes cover.

    Gives ``(doc_id, text, spans)``: ``spans`` is null where nothing repeats, else an array of
    ``(start, end)`` in no order, which may overlap.  A null text is empty; shorter texts
    than ``length`` have no spans; equal rows are occurrences of their own, so a repeated row
    of enough bytes is covered whole; an empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    # rows that agree in both keys hold the same text, so their spans are the same too
    keyed = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"), "doc_id", "text")
    repeated = _repeated_anchors(rows, length)
    segments = _segments(keyed.select("k1", "k2", "text"), length).join(repeated, "anchor")
    segment = F.struct("anchor", "start", "size").alias("segment")
    by_text = segments.groupBy("k1", "k2").agg(F.collect_set(segment).alias("segments"))
    found = stored(_contents(keyed.select("k1", "k2", "text").join(by_text, ["k1", "k2"])), "suffix-dedup")

    sizes = found.groupBy("anchor").agg(F.sum(F.length("content")).alias("b")).where(F.col("b") > hot_bytes)
    hot = stored(sizes.select("anchor"), "suffix-dedup")
    runs = _sorted_shards(found.join(hot, "anchor", "left_anti"), length)
    if not hot.isEmpty():
        runs = runs.union(_single_strings(found.join(hot, "anchor", "left_semi"), length))
    runs = runs.where(F.size("runs") > 0)
    span = F.struct(
        (F.col("place.start") + F.col("run.start")).alias("start"), (F.col("place.start") + F.col("run.end")).alias("end")
    )
    places = found.select("anchor", "digest", F.explode("places").alias("place"))
    covered = (
        places.join(runs, ["anchor", "digest"])
        .select("place", F.explode("runs").alias("run"))
        .groupBy(F.col("place.k1").alias("k1"), F.col("place.k2").alias("k2"))
        .agg(F.collect_set(span).alias("spans"))
    )
    return keyed.join(covered, ["k1", "k2"], "left").select("doc_id", "text", "spans")


def _merged(spans: list[dict[str, int]] | None) -> list[list[int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def remove_repeats(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, removed)`` of each row of ``docs``.

    ``kept`` holds the remaining bytes, which need not be UTF-8 any more, and ``removed`` the
    maximal removed runs.  Nulls, empty tables and equal rows are treated as in
    ``repeated_spans``.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        data = _bytes(batch)
        runs = [_merged(x) for x in batch.column("spans").to_pylist()]
        kept = []
        for text, cut in zip(data, runs):
            borders = [0, *(x for run in cut for x in run), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2])))
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(x) for x in data],
            "n_removed": [len(x) - len(y) for x, y in zip(data, kept)],
            "n_spans": [len(x) for x in runs],
            "kept": kept,
            "removed": [[{"start": a, "end": b} for a, b in x] for x in runs],
        }

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start: long, end: long>>"
    return map_batches(repeated_spans(docs, length, **options), run, schema)
