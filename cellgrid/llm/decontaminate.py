"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_batches, small_batches, stored, texts
from cellgrid.operators.joins import lookup_join

WORD = re.compile(r"[^\W_]+")
# Scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, ideographs. Each character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_CHAR = re.compile(f"[{UNSPACED}]")
MIXED_WORD = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
# Token positions that a seed reads (1) and ignores (0).  Any 2 of 12, 3 of 15 or 4 of 20 words may differ
# and one mask still fits; a longer stretch holds one of 12 to 23 words with as large a share of equal ones.
MASKS = ("1110111", "1101001011", "110010001011")
LEAST_WORDS = 5  # of a test item that may lie within a text; shorter ones are sought as whole texts
FILTER_BITS = (20, 28)  # of the filter that is sent to the executors: 256 kB to 64 MB, by the number of test seeds
BITS_PER_SEED = 32
KNOWN_ROWS = 200_000  # rows of (key, key) that may be broadcast


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; in scripts without spaces, their characters."""
    text = text.lower()
    unspaced = not text.isascii() and UNSPACED_CHAR.search(text)
    return (MIXED_WORD if unspaced else WORD).findall(text)


def token_hashes(text: str) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w.encode("utf-8", "surrogatepass")) for w in words(text)]), ">u8").astype(np.uint64)


def short_masks(n: int) -> list[str]:
    """Masks of a whole item of ``n`` words of which one in five may differ.

    Places are dealt into groups, three where one word may differ and four where two may. A mask
    ignores as many groups as words may differ, so each choice of words is ignored by one of at most
    six masks, and each reads two words in five or more.
    """
    differ = n // 5
    groups = differ + 2 if differ else 1
    return ["".join("01"[k % groups not in left] for k in range(n)) for left in combinations(range(groups), differ)]


def masks_for(sizes: list[int]) -> list[str]:
    """The fixed masks, and masks of the whole item for the sizes too short for them."""
    span = max(map(len, MASKS))
    short = sorted({n for n in sizes if 0 < n < span})
    return list(dict.fromkeys([*MASKS, *(mask for n in short for mask in short_masks(n))]))


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """One hash per position at which the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, xxhash.xxh64_intdigest(mask), np.uint64)
    for place, read in enumerate(mask):
        if read == "1":
            total = (total ^ tokens[place : place + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
    return total


def filter_bits(n_seeds: int) -> int:
    """Width of a place in the filter: ``BITS_PER_SEED`` places a seed, between ``FILTER_BITS``."""
    return min(max((n_seeds * BITS_PER_SEED).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def _slots(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in the filter."""
    low = np.uint64((1 << width) - 1)
    return (hashes & low).astype(np.int64), (hashes >> np.uint64(64 - width)).astype(np.int64)


def _fits(mask: str, n_tokens: int) -> bool:
    """A mask of a very short item reads nothing but whole texts."""
    return len(mask) >= LEAST_WORDS or len(mask) == n_tokens


def _item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        columns: dict[str, list] = {"seed": [], "item_id": [], "place": []}
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            tokens = token_hashes(text)
            for mask in masks:
                if mask not in MASKS and len(mask) != len(tokens):
                    continue
                found = seeds(tokens, mask).view(np.int64)
                columns["seed"] += found.tolist()
                columns["item_id"] += [item] * len(found)
                columns["place"] += range(len(found))
        return columns

    return map_batches(items, run, "seed long, item_id long, place long")


def _filter(seed_rows: DataFrame) -> np.ndarray:
    """Bits of all test seeds, put together slot by slot in Spark; 64 MB at most."""
    width = filter_bits(seed_rows.count())
    low = F.col("seed").bitwiseAND(F.lit((1 << width) - 1))
    high = F.shiftrightunsigned("seed", 64 - width)
    slot = seed_rows.select(F.explode(F.array(F.struct(F.lit(0).alias("f"), low.alias("s")), F.struct(F.lit(1).alias("f"), high.alias("s")))).alias("x"))
    byte = F.shiftright("x.s", 3).cast("int").alias("byte")
    bit = F.expr("shiftleft(1, cast(x.s % 8 as int))")
    found = slot.groupBy(F.col("x.f").alias("f"), byte).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros((2, 1 << (width - 3)), np.uint8)
    bits[found["f"].to_numpy(), found["byte"].to_numpy()] = found["bits"].to_numpy()
    return bits


def _hits(docs: DataFrame, bits: np.ndarray, masks: list[str]) -> DataFrame:
    """Places of documents whose seed may be a test seed."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        columns: dict[str, list] = {"k1": [], "k2": [], "seed": [], "at": []}
        bits = shared.value
        width = bits.shape[1].bit_length() + 2
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
            tokens = token_hashes(text)
            for mask in masks:
                if not _fits(mask, len(tokens)):
                    continue
                found = seeds(tokens, mask)
                low, high = _slots(found, width)
                at = np.flatnonzero((bits[0, low >> 3] >> (low & 7)) & (bits[1, high >> 3] >> (high & 7)) & 1)
                columns["seed"] += found[at].view(np.int64).tolist()
                columns["at"] += at.tolist()
                columns["k1"] += [k1] * len(at)
                columns["k2"] += [k2] * len(at)
        return columns

    return map_batches(docs, run, "k1 long, k2 long, seed long, at long")


def longest_overlap(same: np.ndarray) -> tuple[int, int]:
    """Start and size of the longest stretch in which at least four of five entries are true."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    lowest = np.minimum.accumulate(total)
    start = np.searchsorted(-lowest, -total, side="left")
    size = np.arange(len(total)) - start
    end = int(size.argmax())
    return int(start[end]), int(size[end])


def _verified(pairs: DataFrame, least: int) -> DataFrame:
    """Overlaps around the hits; one row per row of ``pairs`` whose best stretch is long enough."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        columns: dict[str, list] = {c: [] for c in ("k1", "k2", "item_id", "start", "n_tokens", "n_match", "item_tokens")}
        known: dict[str, np.ndarray] = {}
        rows = zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "item_id", "item", "shifts")))
        for k1, k2, text, item_id, item_text, shifts in rows:
            tokens = token_hashes(text)
            item = known.setdefault(item_text, token_hashes(item_text))
            best = (0, 0, 0)
            for shift in sorted(shifts):
                low, high = max(shift, 0), min(shift + len(item), len(tokens))
                same = tokens[low:high] == item[low - shift : high - shift]
                start, size = longest_overlap(same)
                best = max(best, (size, int(same[start : start + size].sum()), -(low + start)))
            if best[0] >= min(least, len(item)) and (len(item) >= LEAST_WORDS or len(item) == len(tokens)):
                values = (k1, k2, item_id, -best[2], best[0], best[1], len(item))
                for name, value in zip(columns, values):
                    columns[name].append(value)
        return columns

    schema = "k1 long, k2 long, item_id long, start long, n_tokens long, n_match long, item_tokens long"
    return map_batches(pairs, run, schema)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with two keys; rows that agree in both hold the same id and text."""
    rows = texts(docs, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"), "doc_id", "text")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, start, n_tokens, n_match, item_tokens)``: the longest overlap of each
    document with each test item, where it has ``least`` words or the whole item.

    Words are runs of letters and digits in lower case; in scripts without spaces each character
    is one.  At least four of five words of an overlap are equal, so it survives substitutions.
    Every word position of every document is hashed under every mask; a filter drops places that
    no test seed can have, the rest are joined with the test seeds, and the stretch around each
    hit is verified.  An item of one to four words, which any text may hold, overlaps the texts
    that consist of its words and nothing else.  Null texts and texts without words overlap nothing;
    equal rows give equal rows; rows without overlap are absent; a null id stays null.
    """
    hidden = _pairs(docs, benchmark, least, id_col, text_col, item_col, item_text_col)
    rows = keyed(docs, id_col, text_col).select("k1", "k2", "doc_id")
    found = lookup_join(rows, hidden, ["k1", "k2"], "inner", KNOWN_ROWS)
    return found.select("doc_id", "item_id", "start", "n_tokens", "n_match", "item_tokens")


def _pairs(docs, benchmark, least, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    items = benchmark.select(
        benchmark[item_col].cast("long").alias("item_id"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text")
    )

    small_batches(docs.sparkSession)

    @F.pandas_udf("int")
    def n_words(text: pd.Series) -> pd.Series:
        return text.map(lambda x: len(words(x))).astype("int32")

    # at most as many sizes as the masks are long reach the driver
    short = items.select(n_words("text").alias("n")).where(F.col("n") < max(map(len, MASKS))).distinct().collect()
    masks = masks_for([row.n for row in short])
    seed_rows = stored(_item_seeds(items, masks), "decontaminate")
    rows = keyed(docs, id_col, text_col).select("k1", "k2", "text")
    hits = _hits(rows, _filter(seed_rows), masks)
    met = lookup_join(hits, seed_rows, ["seed"], "inner", KNOWN_ROWS)
    shift = (F.col("at") - F.col("place")).alias("shift")
    met = met.select("k1", "k2", "item_id", shift).groupBy("k1", "k2", "item_id").agg(F.collect_set("shift").alias("shifts"))
    met = stored(met, "decontaminate")
    hit_rows = lookup_join(rows, met.select("k1", "k2").distinct(), ["k1", "k2"], "inner", KNOWN_ROWS).distinct()
    pairs = hit_rows.join(met, ["k1", "k2"])
    named = items.where("text != ''").select("item_id", F.col("text").alias("item"))
    pairs = lookup_join(pairs, named, ["item_id"], "inner", KNOWN_ROWS // 20)
    best = F.max(F.struct("n_tokens", "n_match", "start", "item_tokens")).alias("b")
    found = _verified(pairs, least).groupBy("k1", "k2", "item_id").agg(best)
    return stored(found.select("k1", "k2", "item_id", "b.*"), "decontaminate")


def clean_only(docs: DataFrame, benchmark: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap a test item; all columns stay."""
    found = _pairs(docs, benchmark, least, id_col, text_col).select("k1", "k2").distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    k1 = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("k1")
    k2 = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("k2")
    marked = lookup_join(docs.select(row, k1, k2), found.withColumn("found", F.lit(True)), ["k1", "k2"], "left", KNOWN_ROWS)
    return marked.where("found is null").select("row.*")
