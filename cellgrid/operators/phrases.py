"""The longest phrase of a table that a text holds, by one pass over its words."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.scalars import phrase_text
from cellgrid.operators.joins import lookup_join, row_bound, salted_join

PHRASE_ROWS = 100_000  # phrases that are compiled on the driver and sent to the executors, some 30 MB


def automaton(phrases: list[list[str]]) -> tuple[dict[tuple[int, str], int], list[int], list[int]]:
    """``(steps, fallback, best)`` over words, for phrases in order of preference.

    ``steps`` leads from a state by a word to the next, ``fallback`` to the longest other state
    that ends alike, and ``best`` is the first phrase that ends at a state (or none: their number).
    """
    steps: dict[tuple[int, str], int] = {}
    fallback, best, children = [0], [len(phrases)], [[]]
    for rank, words in enumerate(phrases):
        state = 0
        for word in words:
            if (state, word) not in steps:
                steps[state, word] = len(best)
                children[state].append((word, len(best)))
                fallback.append(0)
                best.append(len(phrases))
                children.append([])
            state = steps[state, word]
        best[state] = min(best[state], rank)
    waiting = deque(state for _, state in children[0])
    while waiting:  # by depth, so that what a state falls back to is finished
        state = waiting.popleft()
        best[state] = min(best[state], best[fallback[state]])
        for word, child in children[state]:
            at = fallback[state]
            while at and (at, word) not in steps:
                at = fallback[at]
            fallback[child] = steps.get((at, word), 0)
            waiting.append(child)
    return steps, fallback, best


def first_ranked(words: Iterable[str], steps: dict, fallback: list[int], best: list[int]) -> int:
    """The most preferred phrase among ``words``; the number of phrases if there is none."""
    state, found = 0, best[0]
    for word in words:
        while state and (state, word) not in steps:
            state = fallback[state]
        state = steps.get((state, word), 0)
        found = min(found, best[state])
    return found


def tag_phrases(texts: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase", max_rows: int = PHRASE_ROWS) -> DataFrame:
    """``texts`` with ``found``: the longest phrase among its whole words, NULL if there is none.

    Phrases and texts are compared as lower-case words with one blank between; ``found`` is the phrase
    in that form. Among equally long ones the first in order wins. Phrases without words are never found,
    repeated ones count once, and a null text holds none.

    Up to ``max_rows`` phrases are compiled into an automaton, which reads each text once however
    many phrases there are, and texts do not move. Beyond, runs of words as long as some phrase
    are joined with the table of phrases.
    """
    clean = phrases.select(F.trim(phrase_text(phrase)).alias("found")).where("found != ''").distinct()
    if row_bound(clean, max_rows):
        return _by_automaton(texts, clean, text)
    return _by_join(texts, clean, text)


def _by_automaton(texts: DataFrame, clean: DataFrame, text: str) -> DataFrame:
    names = sorted((row.found for row in clean.collect()), key=lambda p: (-len(p), p))
    plain = texts.sparkSession.sparkContext.broadcast((names, *automaton([p.split(" ") for p in names])))

    @F.pandas_udf("string")
    def longest(column: pd.Series) -> pd.Series:
        names, steps, fallback, best = plain.value
        ranks = (None if x is None else first_ranked(x.split(" "), steps, fallback, best) for x in column)
        return pd.Series([None if k is None or k == len(names) else names[k] for k in ranks], dtype=object)

    return texts.withColumn("found", longest(F.trim(phrase_text(text))))


def _by_join(texts: DataFrame, clean: DataFrame, text: str) -> DataFrame:
    """Each text is one key, however many rows repeat it; its runs of words meet the phrases."""
    sizes = clean.agg(F.collect_set(F.size(F.split("found", " "))).alias("sizes"))  # one row of few numbers
    keyed = texts.withColumn("text_key", F.sha2(F.col(text).cast("string"), 256))
    words = keyed.select("text_key", F.split(F.trim(phrase_text(text)), " ").alias("w")).where("text_key IS NOT NULL").dropDuplicates(["text_key"])
    sized = words.join(F.broadcast(sizes)).select("text_key", "w", F.explode("sizes").alias("k"))
    runs = sized.select("text_key", F.explode(F.expr(
        "array_distinct(transform(sequence(1, greatest(size(w) - k + 1, 1)), i -> array_join(slice(w, i, k), ' ')))"
    )).alias("found"))
    met = lookup_join(runs, clean, ["found"], "inner", few_is_small=False)
    best = met.groupBy("text_key").agg(F.min(F.struct(-F.length("found"), "found"))["found"].alias("found"))
    return salted_join(keyed, best, ["text_key"], "left").drop("text_key")
