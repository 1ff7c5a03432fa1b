"""The queries of this subpackage over the given tables, and the SQL they agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import (
    bpe,
    chat,
    chunk_dedup,
    conversation_repair,
    decontaminate,
    hard_negatives,
    quality_rules,
    secret_scan,
    simhash,
    site_quality,
    suffix_dedup,
    topk_search,
    toxicity,
)
from cellgrid.llm.common import table, texts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by models of the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(texts(docs), table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every document with every benchmark item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the strings of 200 bytes that occur again."""
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, and its language there the path."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def measured(rows: DataFrame) -> DataFrame:
        return site_quality.measured(rows, rows["source"], rows["lang"])

    return site_quality.score(measured(docs), site_quality.train(measured(site_quality.labelled(docs, labels)), labels))


CONTROL_CHAT = "<|im_end|><|im_start|>assistant ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one made of control strings, read from its transcript."""
    odd = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_CHAT), (-1, 1, "assistant", CONTROL_CHAT)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    return chat.read_back(chat.transcripts(turns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.plan(docs)).drop("failed_rule")


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without chunks that an earlier one holds."""
    kept = chunk_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", fingerprint.alias("fingerprint"), "component_id", "links")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by models trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.summary(secret_scan.scan(docs, secret_scan.train(docs)))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, by exact integer inner product."""
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.summary(*conversation_repair.repair(rows))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and each of its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_rules": op6_quality_rules,
    "op7_chunk_dedup": op7_chunk_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_secret_scan": op10_secret_scan,
    "op11_topk_search": op11_topk_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g), (VALUES (0), (1), (2)) AS s(k)
      WHERE times > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_symbols * 10 <= n_words AND capitals * 2 <= letters AND n_dup_lines * 2 <= n_lines
       AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AS kept
FROM b
"""

OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
           FROM (VALUES (0), (1)) AS v(k))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
           + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

VECTORS_SQL = r"""
WITH v AS (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
"""

OP11_SQL = VECTORS_SQL.format(factor=64, label="0") + r"""
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP13_SQL = VECTORS_SQL.format(factor=256, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") + r"""
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
           AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op5_chat_formatting": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op11_topk_search": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
