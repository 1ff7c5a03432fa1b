"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_batches, stored, texts
from cellgrid.llm.components import components
from cellgrid.operators.joins import lookup_join, salted_join

# (first bit, bits, radius) of each table.  Two fingerprints that differ in at most
# sum(radius + 1) - 1 bits differ in at most ``radius`` bits of at least one segment.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
BLOCK = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """Majority bits of the XXH64 values (seed 42) of all word shingles, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) < words:
        return int.from_bytes(digest(joined, 42), "big")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of each row; ``fp`` holds the 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        values = (fingerprint(text, words) for text in batch.column("text").to_pylist())
        return {
            "doc_id": batch.column("doc_id"),
            "text_hash": batch.column("text_hash"),
            "fp": np.fromiter(values, np.uint64, batch.num_rows).view(np.int64),
        }

    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, fp long", sliced=True)


def links(fps: DataFrame, max_bits: int = 4, segments=SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints, ``a < b``, that differ in at most ``max_bits`` bits.

    Every fingerprint lies once in each segment's table and looks up the Hamming ball around
    its own segment there; the complete distance is part of the join's condition, so only
    links leave the join.  Large buckets are ordinary join keys that adaptive execution
    splits, and no bucket has a cap.
    """
    if sum(radius + 1 for _, _, radius in segments) <= max_bits or sum(bits for _, bits, _ in segments) != 64:
        raise ValueError("the segments do not reach every pair within max_bits")
    homes, balls = [], []
    for number, (first, bits, radius) in enumerate(segments):
        key = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        homes.append(F.struct(F.lit(number).alias("t"), key.alias("key")))
        for n in range(radius + 1):
            for flips in combinations(range(bits), n):
                mask = sum(1 << x for x in flips)
                balls.append(F.struct(F.lit(number).alias("t"), key.bitwiseXOR(F.lit(mask)).alias("key")))
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(*homes)).alias("h")).select("b", "h.t", "h.key")
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.array(*balls)).alias("h")).select("a", "h.t", "h.key")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    pairs = probe.hint("merge").join(index.hint("merge"), ["t", "key"]).where(near)
    return pairs.select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4
) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, links)`` of each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included, and
    ``links`` the number of other fingerprints linked to the row's.  A null or wordless text
    has fingerprint zero and links like any other.  Rows with equal ids or texts each get a
    row; a null id takes part in links but is never a ``component_id`` unless all ids of the
    component are null.  An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash")
    pairs = stored(links(distinct, max_bits), "simhash")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs).withColumnRenamed("node", "fp")
    linked = distinct.join(degree, "fp").join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = salted_join(linked, least, ["root"]).select("fp", "component_id", "links")
    alone = distinct.join(degree, "fp", "left_anti").select("fp", "first_id", F.lit(0).cast("long").alias("links"))
    return salted_join(rows, linked.union(alone), ["fp"]).select("doc_id", "text_hash", "fp", "component_id", "links")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Of several rows with that id, the text with the smallest hash stays, and of rows equal in
    both, one.  If all ids of a component are null, the same holds of its rows.

    Who stays is decided on ids and hashes alone.  Only the keys that go, and those of several
    equal rows, are looked up by the whole rows, so texts are not moved unless there are more
    such keys than may be broadcast.
    """
    groups = near_duplicates(docs, id_col, text_col, **options)
    key = F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).alias("k")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = first.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(
        F.min("text_hash").alias("t")
    )
    stay = stay.select(F.struct(F.col("component_id").alias("i"), "t").alias("k"), F.lit(True).alias("stays")).distinct()
    times = groups.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    listed = times.join(stay, "k", "left").where("stays is null or times > 1")
    listed = stored(listed.select("k", F.col("stays").isNotNull().alias("several")), "simhash")

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = F.struct(docs[id_col].cast("long").alias("i"), F.xxhash64(text).alias("t")).alias("k")
    marked = lookup_join(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), own), listed, ["k"], "left")
    kept = marked.where("several is null").select("r.*")
    if listed.where("several").isEmpty():
        return kept
    return kept.union(marked.where("several").groupBy("k").agg(F.first("r").alias("r")).select("r.*"))
