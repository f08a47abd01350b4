"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (
    chat, decontam, exact_dedup, line_dedup, mixing, near_dedup, pii, quality, repair, sharding, simhash, vector_codes, warc,
)

Query = Callable[[SparkSession, str], DataFrame]

#: The session setting with the key of the pseudonyms, and what the query takes where it is unset.
PII_KEY, SAMPLE_KEY = "spark.weftnet.pii.key", "key of the registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, table(spark, sf_dir, "documents")).drop("chunks")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(spark, table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages")).drop("intact")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("row_hash")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, SAMPLE_KEY))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), percent=85).drop("row_hash", "stays")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.drop("row_hash")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark, table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_exact_dedup, op3_mixing, op4_warc, op5_decontamination, op6_pii,
        op7_near_dedup, op8_sharding, op9_quality, op10_chat, op11_repair, op12_simhash, op13_vector_codes,
    )}


def oracle_sql() -> dict[str, str]:
    """Without op6 (a keyed permutation by loops), op8 (an iteration), op9 (a fit), op11 (shortest paths, a checksum) and
    op12 (a hash that SQL lacks): see tests/llm."""
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op4_warc": warc.ORACLE,
        "op5_decontamination": decontam.ORACLE,
        "op7_near_dedup": near_dedup.ORACLE,
        "op10_chat": chat.ORACLE,
        "op13_vector_codes": vector_codes.ORACLE,
    }
