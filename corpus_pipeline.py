"""The corpus pipeline: five stages over ``documents``, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again for the next one. All but the last return the
columns of ``documents``; the last adds where each row goes.

Edge cases, the same for every stage: a null text counts as empty, and empty texts are
clean, without near copies and without words to mix; rows with a null or a repeated
doc_id are told apart by a hash of their text, so a verdict on one never drops another;
rows that repeat in full get one verdict; texts may be of any length; further columns,
whatever their names, are passed on by all stages but the last; an empty table goes
through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm import decontam, mixing, near_dedup, quality, sharding
from weftnet.llm.common import Scratch

#: Percent: texts whose sets of shingles have this similarity or more are near duplicates.
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by doc_id and row_hash; ids alone may be null or repeat."""
    gone = gone.select(F.col("doc_id").alias("__wn_id"), F.col("row_hash").alias("__wn_h")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__wn_id")) & (own == F.col("__wn_h"))
    return docs.join(gone, same, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a tie at the threshold stays."""
    return quality.drop_rejected(spark, docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest doc_id stays; of rows that repeat it, one.

    Rows without ids come last, and where a group has none, the smallest text hash decides. Rows of one doc_id
    and text are one, also if the text is null or empty.
    """
    verdicts = near_dedup.near_duplicates(spark, docs, NEAR_PERCENT)
    left = _without(docs, verdicts.filter(~F.col("stays")))
    # rows with the same doc_id: a pre-aggregated count finds them, and only they are compared
    twice = left.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__wn_id"))
    same = left["doc_id"].eqNullSafe(F.col("__wn_id"))
    repeats = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(repeats)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, four fifths of its shingles or more, go; without items all stay."""
    pairs = decontam.contaminated_pairs(spark, docs, _table(spark, sf_dir, "benchmark"))
    found = Scratch(spark, "leaks").save(pairs.select("doc_id", "row_hash").distinct(), "found")
    return _without(docs, found)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    A pass that takes half of a document's words or more takes the whole text; a lesser one is not made.
    Documents without words are not taken. A null source is a source.
    """
    passes = mixing.schedule(mixing.curriculum(docs))
    return passes.filter(2 * F.col("words") >= F.col("size")).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes, without its text; rows with a null doc_id are placed too."""
    return sharding.shard(spark, docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is trained and the shards come from an iteration: no SQL tells them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
