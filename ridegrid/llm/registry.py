"""Queries of the text operators, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridegrid.llm import oracle_queries
from ridegrid.llm.common import prepare, table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.exact_dedup import exact_groups

    prepare(spark)
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.chat_format import format_conversations, probe

    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return format_conversations(rows.unionByName(probe(rows)))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.near_dedup import near_groups

    prepare(spark)
    return near_groups(table(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.hilbert_shards import assign_shards

    prepare(spark)
    return assign_shards(table(spark, sf_dir, "documents"))


def op5_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.bpe import encode_decode

    prepare(spark)
    return encode_decode(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.language_id import identify

    prepare(spark)
    return identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.token_counts import count_tokens

    prepare(spark)
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.decontaminate import contamination, digest

    prepare(spark)
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), places=False))


def op9_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.pii import digest, find_spans

    prepare(spark)
    return digest(find_spans(table(spark, sf_dir, "documents")))


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.quality import score_quality

    prepare(spark)
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.periodic_runs import periodic_runs

    prepare(spark)
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.conversation_repair import repair

    prepare(spark)
    return repair(table(spark, sf_dir, "conversations"), harmed=True)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridegrid.llm.toxicity import score_toxicity

    prepare(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, QueryFn] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_chat_format, op3_order_minhash, op4_hilbert_shards, op5_bpe_stream, op6_language_id,
        op7_token_counts, op8_decontaminate, op9_pii_boosting, op10_attention_quality, op11_periodic_runs,
        op12_conversation_repair, op13_toxicity, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op11_periodic_runs": oracle_queries.PERIODIC_RUNS,
    "op12_conversation_repair": oracle_queries.CONVERSATION_REPAIR,
}


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
