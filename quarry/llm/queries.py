"""Queries of this subpackage for the driver, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, secrets, token_files, token_rollup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), n=3, threshold=(90, 100))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_index(spark, folder)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed, their records rebuilt into WARC files, and those files parsed."""
    folder, target = common.scratch(spark, "warc"), common.scratch(spark, "warc-out")
    warc.pack(_table(spark, sf_dir, "pages"), folder)
    files = warc.write_warc(spark, folder, target, packed=True)
    return warc.read_files(spark, target, files)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.report(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents, one of them sent twice: all inserted with the counts of one
    tokenizer; all revised to those of another; later copies of a text deleted.
    """
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    one = common.materialize(token_rollup.counted(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), "rollup-one")
    two = common.materialize(token_rollup.counted(docs, public_tokenizers.path("byte_bpe_50k.json")), "rollup-two")
    shared = one.groupBy("digest").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    copies = one.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")).join(salted, ["digest", "salt"]).where("doc_id <> keep")
    store = token_rollup.Store(spark, common.scratch(spark, "rollup"))
    revision = two.withColumn("op", F.lit("revise"))
    store.commit("1-insert", one.withColumn("op", F.lit("insert")))
    store.commit("2-revise", revision)
    store.commit("3-delete", copies.withColumn("op", F.lit("delete")))
    store.commit("2-revise", revision)
    return store.totals()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_files": op3_token_files,
    "op4_warc": op4_warc,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_rollup": op9_token_rollup,
    "op10_decontaminate": op10_decontaminate,
}

from .oracles import ORACLE_SQL  # noqa: E402

__all__ = ["ORACLE_SQL", "QUERIES"]
