"""Corpus pipeline: documents through five of the text operators, each stage written as Parquet and read again.

1. language_id: documents without an identified language (null text, no letter) go.
2. exact_dedup: of equal texts (A-Z lower-cased) the one with the largest doc_id stays.
3. near_dedup: of each near-duplicate group the one with the least doc_id stays.
4. decontaminate: documents that hold a benchmark window go.
5. bpe: the remaining documents, encoded and decoded (counts and digests).

All but the last stage return the columns of ``documents``, unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridegrid.llm.bpe import encode_decode
from ridegrid.llm.common import prepare, stage, table
from ridegrid.llm.decontaminate import drop_contaminated
from ridegrid.llm.exact_dedup import drop_exact
from ridegrid.llm.language_id import drop_unidentified
from ridegrid.llm.near_dedup import drop_near


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: SQL can express neither the language model, nor the sketches and alignments, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole ``documents`` table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
