"""Toxicity by class-conditional Kneser-Ney models of spelling."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import built, map_batches, slices, small_batches, stored, texts
from cellgrid.operators.joins import lookup_join, row_bound

ORDER = 5
START, END = "\x02", "\x03"
BROADCAST_GRAMS = 4_000_000  # grams and contexts whose ratios are sent to the executors, 16 bytes each; more are joined
WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 1 << 17
TOP = (2, 6, 12)  # so many most toxic words are averaged
CALIBRATION_SHARE = 6  # one in so many labelled ids may calibrate instead of being counted
CALIBRATION_ROWS = 20_000  # at most, the ones with the smallest hashed ids


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Labelled rows of ``docs`` that are not held out, with ``toxic`` and ``calibrates``.

    A document with several labels counts as toxic if one of them says so; null labels and ids
    count for nothing.  The labels are broadcast up to a checked number of rows; beyond,
    both sides are shuffled.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).alias("toxic"))
    known = known.where(remainder(F.col("doc_id")) != 2)
    known = known.withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_SHARE)) == 0)
    bound = {} if max_rows is None else {"max_rows": max_rows}
    return lookup_join(docs, known, ["doc_id"], "inner", **bound)


def _word_counts(rows: DataFrame) -> DataFrame:
    """``(word, toxic, ordinary)`` token counts; counted per batch before they are shuffled."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        counts = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(WORD.findall(text.lower()))
        words = list(counts[0] | counts[1])
        return {"word": words, "toxic": [counts[1][w] for w in words], "ordinary": [counts[0][w] for w in words]}

    counted = map_batches(rows.select("text", "toxic"), run, "word string, toxic long, ordinary long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _spelled(words: DataFrame) -> DataFrame:
    """``words`` with one row for each ``gram`` of each word."""
    spelled = F.concat(F.lit(START), "word", F.lit(END))
    ends = F.sequence(F.lit(2), F.length("word") + 2)
    gram = F.transform(ends, lambda i: F.substring("spelled", F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))
    return words.withColumn("spelled", spelled).select(F.explode(gram).alias("gram"), *words.columns)


def _grams(words: DataFrame) -> DataFrame:
    """Counts of each character with up to four before it, the word's borders included."""
    return _spelled(words).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _shared_backoff(grams: DataFrame, discount: float) -> DataFrame:
    """``(gram, shared)``: the lower-order model that both classes share.

    It is built on continuation counts: in how many different longer grams of either class a
    gram occurs.
    """
    longer = grams.select("gram").where(F.length("gram") == ORDER)
    levels = []
    for size in range(ORDER - 1, 0, -1):
        level = longer.groupBy(F.substring("gram", F.lit(2), F.lit(size)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        level = stored(level, "toxicity")
        levels.append(level)
        anchored = grams.select("gram").where((F.length("gram") == size) & F.col("gram").startswith(START))
        longer = level.select("gram").union(anchored)
    symbols = levels[-1].count() or 1
    lower = None
    for level in reversed(levels):
        head, tail = _head(), F.expr("substring(gram, 2)")
        context = level.groupBy(head.alias("head")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        level = level.withColumn("head", head).withColumn("tail", tail).join(context, "head")
        if lower is None:
            level = level.withColumn("below", F.lit(1.0 / symbols))
        else:
            level = level.join(lower.select(F.col("gram").alias("tail"), F.col("shared").alias("below")), "tail")
        shared = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("below")) / F.col("total")
        lower = level.select("gram", shared.alias("shared")) if lower is None else lower.union(level.select("gram", shared.alias("shared")))
    return lower


def _head() -> Column:
    return F.expr("substring(gram, 1, length(gram) - 1)")


def log_ratios(grams: DataFrame, discount: float) -> DataFrame:
    """``(key, kind, ratio, weight)``: toxic against ordinary log-probability.

    For a known gram (kind 0) of its last character; for a context (kind 1) of the mass it
    leaves to the backoff.  A gram that neither class has seen is judged by its context
    alone, because the shared backoff cancels out.
    """
    context = grams.groupBy(_head().alias("head")).agg(
        *[F.sum(c).alias(f"{c}_total") for c in ("toxic", "ordinary")],
        *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "ordinary")],
    )

    def left(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(F.lit(1.0))

    def seen(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(F.lit(0.0))

    shared = _shared_backoff(grams, discount).withColumnRenamed("gram", "tail")
    known = grams.withColumn("head", _head()).withColumn("tail", F.expr("substring(gram, 2)"))
    known = known.join(context, "head").join(shared, "tail")
    p_toxic, p_ordinary = (seen(c) + left(c) * F.col("shared") for c in ("toxic", "ordinary"))
    by_gram = known.select(
        F.col("gram").alias("key"), F.lit(0).alias("kind"), F.log(p_toxic / p_ordinary).alias("ratio"),
        (F.col("toxic") + F.col("ordinary")).alias("weight"),
    )
    by_context = context.select(
        F.col("head").alias("key"), F.lit(1).alias("kind"), F.log(left("toxic") / left("ordinary")).alias("ratio"),
        (F.col("toxic_total") + F.col("ordinary_total")).alias("weight"),
    )
    return by_gram.union(by_context)


@dataclass
class SpellingModel:
    """Log ratios by gram and by context, and the weights of what they make of a text.

    Up to ``BROADCAST_GRAMS`` of both, ``tables`` holds for each kind the sorted 64-bit hashes and
    their ratios; beyond, ``ratios`` keeps them in Spark.
    """

    tables: list[tuple[np.ndarray, np.ndarray]] | None
    ratios: DataFrame | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + len(TOP)))
    calibrated: bool = True
    _words: dict[str, float] = field(default_factory=dict)  # ratios of words seen lately, in two generations
    _older: dict[str, float] = field(default_factory=dict)

    def plain(self) -> dict:
        """What the executors need, without a class of this package."""
        return {"tables": self.tables, "weights": self.weights}

    @classmethod
    def of(cls, plain: dict) -> SpellingModel:
        return cls(plain["tables"], weights=plain["weights"])

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word's spelling per character."""
        missing = set(words).difference(self._words)
        if missing and len(self._words) + len(missing) > CACHED_WORDS:
            self._older, self._words = self._words, {}
            missing = set(words)
        known = [word for word in missing if word in self._older]
        self._words.update((word, self._older[word]) for word in known)
        missing.difference_update(known)
        if missing:
            grams, sizes = [], []
            for word in missing:
                spelled = START + word + END
                grams += [spelled[max(0, end - ORDER) : end] for end in range(2, len(spelled) + 1)]
                sizes.append(len(word) + 1)
            ratios = self._look(0, grams)
            unseen = np.flatnonzero(np.isnan(ratios))
            ratios[unseen] = np.nan_to_num(self._look(1, [grams[k][:-1] for k in unseen]))
            totals = np.add.reduceat(ratios, np.cumsum([0, *sizes[:-1]]))
            self._words.update(zip(missing, (totals / sizes).tolist()))
        return np.fromiter(map(self._words.__getitem__, words), np.float64, len(words))

    def _look(self, kind: int, grams: list[str]) -> np.ndarray:
        """Ratios of the grams; nan where there is none."""
        keys, ratios = self.tables[kind]
        if not len(keys) or not grams:
            return np.full(len(grams), np.nan)
        digests = b"".join([xxhash.xxh64_digest(gram.encode("utf-8", "surrogatepass"), 42) for gram in grams])
        hashed = np.frombuffer(digests, ">i8").astype(np.int64)
        at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return np.where(keys[at] == hashed, ratios[at], np.nan).astype(np.float64)

    def features(self, text: str) -> list[float]:
        """Ratio per character of the whole text, and of its most toxic words on average."""
        words = WORD.findall(text.lower())
        return _summary(self.words(words), np.fromiter(map(len, words), np.float64, len(words)) + 1)

    def score(self, features: list[float]) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _summary(ratios: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Features of a text from the ratio and the size of each of its words."""
    if not len(ratios):
        return [0.0] * (1 + len(TOP))
    whole = (ratios * sizes).sum() / sizes.sum()
    top = np.zeros(TOP[-1])
    most = ratios if len(ratios) <= TOP[-1] else np.partition(ratios, -TOP[-1])[-TOP[-1] :]
    top[: len(most)] = np.sort(most)[::-1]
    return [float(whole), *(float(top[:k].mean()) for k in TOP)]


def _model(ratios: DataFrame) -> SpellingModel:
    """At most ``BROADCAST_GRAMS`` ratios reach the driver; where there are more, none does."""
    ratios = stored(ratios, "toxicity")
    if not row_bound(ratios, BROADCAST_GRAMS):
        return SpellingModel(None, ratios)
    found = ratios.select("kind", F.xxhash64("key").alias("key"), "ratio").toArrow()
    kinds, keys, values = (found[c].to_numpy() for c in ("kind", "key", "ratio"))
    tables = []
    for kind in (0, 1):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(keys[own])]
        tables.append((keys[own], values[own]))
    return SpellingModel(tables)


def _features(rows: DataFrame, model: SpellingModel) -> DataFrame:
    """``rows`` with ``features`` in place of ``text``."""
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.drop("text").dtypes)
    if model.tables is None:
        return _joined_features(rows, keep, schema, model.ratios)
    shared = rows.sparkSession.sparkContext.broadcast(model.plain())

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        local = built(shared, SpellingModel.of)
        found = [local.features(text) for text in batch.column("text").to_pylist()]
        return {c: batch.column(c) for c in keep} | {"features": found}

    return map_batches(rows, run, f"{schema}, features array<double>", sliced=True)


def _joined_features(rows: DataFrame, keep: list[str], schema: str, ratios: DataFrame) -> DataFrame:
    """The same by joins: each distinct word takes the ratios of its grams, each text those of its words.

    Rows that agree in all columns are worked out once and repeated.
    """

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        words, sizes, at = [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            found = Counter(WORD.findall(text.lower()))
            words += ["", *found]  # the empty word stands for the row itself
            sizes += [1, *found.values()]
            at += [k] * (1 + len(found))
        return {c: batch.column(c).take(pa.array(at, pa.int64())) for c in (*keep, "text_key")} | {"word": words, "n": sizes}

    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    each = map_batches(keyed, count, f"{schema}, text_key long, word string, n long", sliced=True)
    words = each.select("word").where("word != ''").distinct()
    own = ratios.where("kind = 0").select(F.col("key").alias("gram"), F.col("ratio").alias("own"))
    rest = ratios.where("kind = 1").select(F.col("key").alias("head"), F.col("ratio").alias("rest"))
    grams = lookup_join(_spelled(words), own, ["gram"], "left").withColumn("head", _head())
    grams = lookup_join(grams, rest, ["head"], "left")
    total = F.sum(F.coalesce("own", "rest", F.lit(0.0)))
    by_word = stored(grams.groupBy("word").agg((total / (F.length("word") + 1)).alias("ratio")), "toxicity")
    met = lookup_join(each, by_word, ["word"], "left")
    found = met.groupBy(*keep, "text_key").agg(
        F.count_if(F.col("word") == "").alias("copies"),
        F.collect_set(F.when(F.col("word") != "", F.struct("word", "ratio", "n"))).alias("found"),
    )
    found = found.select(*keep, F.explode(F.array_repeat("found", F.col("copies").cast("int"))).alias("found"))
    found = found.select(*keep, *[F.col(f"found.{c}").alias(c) for c in ("ratio", "n")], F.transform("found.word", F.length).alias("size"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        made = []
        for ratio, n, size in zip(*(batch.column(c).to_pylist() for c in ("ratio", "n", "size"))):
            made.append(_summary(np.repeat(np.array(ratio, float), n), np.repeat(np.array(size, float) + 1, n)))
        return {c: batch.column(c) for c in keep} | {"features": made}

    return map_batches(found, run, f"{schema}, features array<double>")


def _score(model: SpellingModel) -> Column:
    """``SpellingModel.score`` of the column ``features``."""
    z = F.lit(float(model.weights[0]))
    for k, weight in enumerate(model.weights[1:]):
        z = z + F.lit(float(weight)) * F.get("features", F.lit(k))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))


def _fitted(x: np.ndarray, toxic: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression, the constant first."""
    x = np.column_stack([np.ones(len(x)), x])
    weights = np.zeros(x.shape[1])
    ridge = penalty * max(len(x), 1) * np.eye(len(weights))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ weights)
        weights += step
        if abs(step).max() < 1e-9:
            break
    return weights


def _calibrating(rows: DataFrame) -> Column:
    """Whether a row calibrates: its hashed id is among the smallest, of ``CALIBRATION_ROWS`` rows at most."""
    hashed = F.xxhash64("doc_id")
    first = rows.where("calibrates").select(hashed.alias("h")).orderBy("h").limit(CALIBRATION_ROWS + 1)
    found = first.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h")).first()
    every = F.col("calibrates")
    return every if found.n <= CALIBRATION_ROWS else every & (hashed < found.h)


def train(rows: DataFrame, discount: float = 0.75) -> SpellingModel:
    """Both models from ``training_rows``.

    Of the rows that may calibrate, at most ``CALIBRATION_ROWS`` give the weights; all others
    are counted.  Without any that calibrate the model is indifferent and predicts nothing as toxic.
    """
    rows = rows.withColumn("calibrates", _calibrating(rows))
    grams = stored(_grams(_word_counts(rows.where("not calibrates"))), "toxicity")
    model = _model(log_ratios(grams, discount))
    found = _features(rows.where("calibrates").select("doc_id", "text", "toxic"), model)
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id", "features").collect()
    model.calibrated = bool(sample)
    x = np.array([r.features for r in sample]).reshape(-1, 1 + len(TOP))
    model.weights = _fitted(x, np.array([float(r.toxic) for r in sample]))
    return model


def score(docs: DataFrame, model: SpellingModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row; only the text enters the score.

    A null, empty or wordless text has features zero and the score the model gives them.  Equal
    rows get equal scores; a row with a null id is not held out.
    """
    scored = _features(texts(docs, id_col, text_col), model).select("doc_id", _score(model).alias("score"))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.lit(model.calibrated) & (F.col("score") >= threshold)).cast("int").alias("predicted")
    )


def ordinary_only(docs: DataFrame, model: SpellingModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay."""
    if not model.calibrated:
        return docs
    if model.tables is None:
        return _ordinary_joined(docs, model, threshold, text_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    @F.arrow_udf("boolean")
    def is_ordinary(text: pa.Array) -> pa.Array:
        local = built(shared, SpellingModel.of)
        found = []
        for part in slices(pa.record_batch([pc.fill_null(text, "")], ["text"])):
            found += [local.score(local.features(x)) < threshold for x in part.column("text").to_pylist()]
        return pa.array(found, pa.bool_())

    return docs.where(is_ordinary(F.col(text_col).cast("string")))


def _ordinary_joined(docs: DataFrame, model: SpellingModel, threshold: float, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    k1, k2 = F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")
    scored = _features(docs.select(k1, k2, text.alias("text")), model)
    toxic = stored(scored.where(_score(model) >= threshold).select("k1", "k2").distinct(), "toxicity")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    marked = lookup_join(docs.select(row, k1, k2), toxic.withColumn("found", F.lit(True)), ["k1", "k2"], "left")
    return marked.where("found is null").select("row.*")
