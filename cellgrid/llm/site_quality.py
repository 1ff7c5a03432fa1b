"""Document quality by hierarchical empirical Bayes over sites."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import let, stored
from cellgrid.llm.quality_rules import symbols, word_chars, words
from cellgrid.llm.toxicity import remainder
from cellgrid.operators.joins import lookup_join

BINS = 16
FEATURES = 6
LIMIT = 6.0  # nats that one feature may say at most


def _share(part: Column, whole: Column) -> Column:
    """A ratio in ``BINS`` steps; 0 where there is nothing to divide."""
    ratio = F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    return F.least(F.floor(ratio * BINS), F.lit(BINS - 1)).cast("int")


def _steps(value: Column) -> Column:
    return F.least(F.floor(F.log2(value.cast("double") + 1)), F.lit(BINS - 1)).cast("int")


def features(text: Column) -> Column:
    """Bins of a text: an array with one small number per feature."""
    capitals, letters = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{L}"))
    marks, chars = F.regexp_count(text, F.lit("[!?]")), word_chars(text)

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.array(
            _share(symbols(text), n), _share(capitals, letters), _share(marks, n), _share(F.size(F.array_distinct(w)), n),
            _steps(n), F.least(F.floor(F.coalesce(chars / F.nullif(n, F.lit(0)), F.lit(0.0))), F.lit(BINS - 1)).cast("int"),
        )

    return let(words(text), of)


def _shrink(groups: DataFrame, by: str) -> DataFrame:
    """``groups`` with ``mean``: its share of good labels, drawn towards ``prior``.

    The strength is the number of labels at which a group's own share weighs as much as the
    prior, by the method of moments: the less groups differ beyond chance, the larger.
    """
    share = F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * (share - F.col("prior")) ** 2)
    chance = F.sum(F.when(F.col("n") > 0, F.col("prior") * (1 - F.col("prior"))))
    total, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    between = (spread - chance) / F.nullif(total - squares / F.nullif(total, F.lit(0)), F.lit(0))
    within = F.avg(F.col("prior") * (1 - F.col("prior")))
    strength = F.least(F.greatest(within / F.greatest(between, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1e6))
    one = groups.agg(F.coalesce(strength, F.lit(1.0)).alias("strength")).first()["strength"]
    return groups.withColumn("mean", (F.col("good") + one * F.col("prior")) / (F.col("n") + one)).select(by, "mean")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


class SiteModel:
    """Evidence per feature bin, and posterior means of hosts and paths."""

    def __init__(self, evidence: list[list[float]], prior: float, hosts: DataFrame, paths: DataFrame) -> None:
        self.evidence, self.prior, self.hosts, self.paths = evidence, prior, hosts, paths


def measured(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, host, path, bins)``; a null host or path is a site of its own."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    host, path = (F.coalesce(c.cast("string"), F.lit("")) for c in (host, path))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), host.alias("host"), F.concat_ws("/", host, path).alias("path"), features(text).alias("bins"))


def _known(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)`` of each labelled id that is not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    return known.where(remainder(F.col("doc_id")) != 2).select(F.col("doc_id").cast("long"), F.col("good").cast("long"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that ``train`` counts, as they are; measure these and not all for it."""
    return lookup_join(docs, _known(labels).select(F.col("doc_id").alias(id_col)), [id_col], "inner").select(*docs.columns)


def train(rows: DataFrame, labels: DataFrame) -> SiteModel:
    """The model from ``measured`` rows and ``(doc_id, quality)`` labels that are not held out.

    A document with several labels is good only if all say so.  All labelled rows are counted;
    a table of features by bins and a few sums reach the driver, whatever the input.  Without
    labels every score is one half.
    """
    seen = stored(lookup_join(rows, _known(labels), ["doc_id"], "inner"), "site-quality")
    counted = seen.select("good", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(
        F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")
    ).collect()
    n, good = (float(x or 0) for x in seen.agg(F.count(F.lit(1)), F.sum("good")).first())
    prior = (good + 1) / (n + 2)
    evidence = [[0.0] * BINS for _ in range(FEATURES)]
    for row in counted:
        p_good = (row.good + 0.5) / (good + 0.5 * BINS)
        p_poor = (row.n - row.good + 0.5) / (n - good + 0.5 * BINS)
        evidence[row.feature][row.bin] = max(-LIMIT, min(LIMIT, log(p_good / p_poor)))
    sums = [F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")]
    hosts = stored(_shrink(seen.groupBy("host").agg(*sums).withColumn("prior", F.lit(prior)), "host"), "site-quality")
    paths = seen.groupBy("host", "path").agg(*sums).join(hosts.withColumnRenamed("mean", "prior"), "host")
    return SiteModel(evidence, prior, hosts, stored(_shrink(paths, "path"), "site-quality"))


def score(rows: DataFrame, model: SiteModel, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, evidence, site, score, keep)`` of each row of ``measured``.

    The site's share is its path's posterior mean, else its host's, else the global prior; the
    document's evidence is added to its log odds.  Null and empty texts are judged by the bins of
    an empty text; equal rows get equal scores.
    """
    table = F.array(*[F.array(*map(F.lit, feature)) for feature in model.evidence])
    said = F.aggregate(
        F.transform("bins", lambda b, k: F.get(F.get(table, k), b)), F.lit(0.0), lambda total, x: total + x
    )
    hosts = model.hosts.withColumnRenamed("mean", "host_mean")
    paths = model.paths.withColumnRenamed("mean", "path_mean")
    placed = lookup_join(lookup_join(rows, hosts, ["host"]), paths, ["path"])
    site = F.coalesce("path_mean", "host_mean", F.lit(model.prior))
    odds = F.exp(-(F.col("evidence") + _logit(F.col("site"))))
    scored = placed.select("doc_id", said.alias("evidence"), site.alias("site")).withColumn("score", 1 / (1 + odds))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "evidence", "site", "score", (F.col("score") >= threshold).alias("keep"))
