"""The registered queries: names, SQL where there is some, and the pipeline stage by stage."""

import re

import pytest
from compare import compare, database
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from cellgrid.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from cellgrid.llm.common import table, texts, tokenizer_path
from cellgrid.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_sql(spark, name):
    diff, rows, _ = compare(spark, database(SF), name, QUERIES[name], ORACLES[name], SF)
    assert diff is None and rows > 0, diff


def test_stages_do_what_their_operators_say(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    rows = [{r.doc_id: r.asDict() for r in df.collect()} for df in seen]
    assert all(df.columns == docs.columns for df in seen[:-1])

    model = toxicity.train(toxicity.training_rows(texts(docs), table(spark, SF, "labels")))
    predicted = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert set(rows[1]) == {i for i, p in predicted.items() if not p}

    fps = {i: simhash.fingerprint(r["text"]) for i, r in rows[1].items()}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] < group[b]:
                    group[b], changed = group[a], True
    assert set(rows[2]) == {i for i in fps if group[i] == i} and len(rows[2]) < len(rows[1])

    words = lambda text: " " + " ".join(decontaminate.WORD.findall(text.lower())) + " "
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    leaky = {i for i, r in rows[2].items() if any(item in words(r["text"]) for item in items)}
    assert set(rows[3]) == set(rows[2]) - leaky and leaky

    masked = {i for i, r in rows[4].items() if r["text"] != rows[3][i]["text"]}
    assert masked == {i for i, r in rows[3].items() if secret_scan.base_spans(r["text"])}
    assert all(not secret_scan.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows[4].values())

    tokenizer = Tokenizer.from_file(tokenizer_path())
    counts = {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) for i, r in rows[4].items()}
    assert {i: r["n_tokens"] for i, r in rows[5].items()} == counts
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, seen[5].collect()))


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    assert bpe.encode(table(spark, SF, "documents").limit(0)).count() == 0
