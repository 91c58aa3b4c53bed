"""Corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, decontaminate, mixing, ngram_join, quality_rules, token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at 0.8 on five-word shingles."""
    return ngram_join.dedupe(docs, n=5, threshold=(80, 100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of target weights begins them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = common.scratch(spark, "pipeline-tokens")
    token_files.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_index(spark, folder)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
    ("token_files", tokens),
]

#: SQL has no byte-pair encoding; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
