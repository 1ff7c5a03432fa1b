import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellgrid.llm.common import SPACES  # noqa: E402
from text_samples import sentence  # noqa: E402

SCHEMA = (
    "doc_id long, text string, k1 long, k2 string, fp string, spans string, row string, r string, k string, "
    "toxic string, label string, seed string, n_chars long, source string, lang string"
)


def clashing(spark, rows):
    """Documents whose other columns have the names that operators use inside."""
    return spark.createDataFrame([(i, t, *(None,) * 10, None if t is None else len(t), "s", "l") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, repeats of rows and of texts, ties, odd characters, one long text."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (None, base), (None, None), (4, None), (5, ""),
        (6, SPACES), (7, "one"), (8, "two words"), (8, "other words"), (9, "a" * 2500), (10, "ab" * 600),
        (11, sentence(rng, 20_000)), (12, "\n".join(["same line here"] * 30)), (13, "日本語 текст 🙂 " * 40),
        (14, sentence(rng, 40) + " " + base[50:400] + " " + sentence(rng, 40)), (15, "\x1c\x85  <|endoftext|> 'll\x00x"),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return clashing(spark, edge_rows).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark, [])
