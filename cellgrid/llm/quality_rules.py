"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import SPACES, let, stored

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000  # about so many rows estimate cost and selectivity; they decide the order only


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def word_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.translate(text, SPACES, "")).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def line_counts(text: Column) -> Column:
    """Lines that hold a word, and how many of them equal an earlier one, from one split."""

    def counts(lines: Column) -> Column:
        repeated = F.size(lines) - F.size(F.array_distinct(lines))
        return F.struct(F.size(lines).cast("long").alias("n"), repeated.cast("long").alias("repeated"))

    return let(word_lines(text), counts)


def repeated_words(parts: Column, window: int = 3) -> Column:
    """Words in windows that occur twice or more; windows are compared by their 64-bit hash."""

    def covered(starts: Column) -> Column:
        def share(start: Column, k: Column) -> Column:
            return F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - start, F.lit(window)))

        return F.aggregate(F.transform(starts, share), F.lit(0), lambda total, x: total + x)

    def among(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def again(rows: Column) -> Column:
            def same(row: Column, k: Column) -> Column:
                before, after = F.get(rows, k - 1)["h"], F.get(rows, k + 1)["h"]
                return row["h"].eqNullSafe(before) | row["h"].eqNullSafe(after)

            return F.sort_array(F.transform(F.filter(rows, same), lambda row: row["k"]))

        repeats = let(let(ordered, again), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeats)

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def counted(w: Column) -> Column:
        return F.when(F.size(w) < window, F.lit(0)).otherwise(let(hashed(w), among))

    return let(parts, counted).cast("long")


@dataclass(frozen=True)
class Rule:
    """A name, and whether a text fails: an expression of the text and, by name, of the columns of ``measure``."""

    name: str
    fails: Callable[[Column], Column]


def _symbol_share(text: Column) -> Column:
    return F.col("n_symbols") * 10 > F.col("n_words")


def _capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}")) * 2 > F.regexp_count(text, F.lit(r"\p{L}"))


def _line_repeats(text: Column) -> Column:
    return F.col("n_dup_lines") * 2 > F.col("n_lines")


def _word_length(text: Column) -> Column:
    mean = F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0))
    return F.coalesce((mean < 2) | (mean > 20), F.lit(False))


RULES = (
    Rule("symbols", _symbol_share),
    Rule("capitals", _capitals),
    Rule("repeated_lines", _line_repeats),
    Rule("word_length", _word_length),
)


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule: seconds per row, and the share it rejects of what came to it."""

    rule: Rule
    cost: float
    rejects: float


def measure(rows: DataFrame) -> DataFrame:
    """``rows`` with what is counted in their ``text``, each measure once."""
    text = F.col("text")
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return rows.withColumns({"counted": counted, "lines": line_counts(text)}).select(
        *rows.columns,
        F.col("counted.n").alias("n_words"),
        word_chars(text).alias("word_chars"),
        symbols(text).alias("n_symbols"),
        F.col("lines.n").alias("n_lines"),
        F.col("lines.repeated").alias("n_dup_lines"),
        F.col("counted.r").alias("n_repeat_words"),
    )


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """``rules`` by rejection per cost on a sample; each is judged on rows the earlier ones pass.

    The order decides how much is computed, never the verdict.  The sample takes distinct texts by
    their hash, about ``sample_rows`` and never more than twice as many.  It is stored with its
    measures, so a rule costs what it adds to them.  An empty table keeps the given order.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    one_in = max(1, docs.count() // sample_rows)
    drawn = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    sample = stored(measure(drawn.distinct().limit(2 * sample_rows)), "rules")
    flags = [rule.fails(F.col("text")).alias(f"r{k}") for k, rule in enumerate(rules)]
    patterns = sample.select(*flags).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()
    total = sum(row["count"] for row in patterns)
    base = _seconds(sample, F.length("text") < 0)
    costs = [max(_seconds(sample, rule.fails(F.col("text"))) - base, 1e-4) / max(total, 1) for rule in rules]
    order: list[Estimate] = []
    left, open_rules = patterns, list(range(len(rules)))
    while open_rules:
        remaining = sum(row["count"] for row in left)
        share = {k: sum(row["count"] for row in left if row[f"r{k}"]) / max(remaining, 1) for k in open_rules}
        best = max(open_rules, key=lambda k: (share[k] / costs[k], -k))
        order.append(Estimate(rules[best], costs[best], share[best]))
        left = [row for row in left if not row[f"r{best}"]]
        open_rules.remove(best)
    return order


def _seconds(sample: DataFrame, condition: Column) -> float:
    """Time of evaluating ``condition`` on every row of the sample, the better of two runs."""
    times = []
    for _ in range(2):
        start = time.perf_counter()
        sample.agg(F.count_if(condition)).collect()
        times.append(time.perf_counter() - start)
    return min(times)


def first_failure(text: Column, order: Sequence[Estimate]) -> Column:
    """Name of the first rule of the cascade that a text fails, else null; later rules are not computed."""
    verdict = None
    for step in order:
        branch = F.when if verdict is None else verdict.when
        verdict = branch(step.rule.fails(text), F.lit(step.rule.name))
    return F.lit(None).cast("string") if verdict is None else verdict


def judge(docs: DataFrame, order: Sequence[Estimate], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of each row.

    Gives ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    failed_rule, kept)``.  The base (too few words, or too many in repeated windows) comes
    first; only texts that pass it meet the cascade, whose rules take the measures as they are.
    A null or empty text has no words and fails the base; equal rows get equal rows; other
    columns are ignored.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    measured = measure(docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_failure(F.col("text"), order))
    judged = measured.withColumn("base_failed", base).withColumn("failed_rule", failed)
    return judged.withColumn("kept", F.col("failed_rule").isNull()).drop("text", "n_lines")
