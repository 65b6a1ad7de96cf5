"""A training-data pipeline over ``documents``: filter, dedup, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of
``documents`` in all but the last. ``run`` writes each result as Parquet in the shared
folder and reads it again, so a lost executor never repeats an earlier stage.

Defined cases: an empty table goes through as one; a null, empty or blank text is scored
by the intercept alone, is near to nothing, leaks nothing, and has no words, so it goes
with its block into the mixture; rows without doc_id are kept by the join and by decontamination;
rows that repeat a doc_id are one document there: all are kept or none, of equal doc_ids
no row is a copy of another. Further columns are kept, whatever their names, but
``shard`` and ``slot`` are replaced and names starting with ``_mix`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsubame.llm import decontaminate, mixing, ngram_join, quality, sharding
from tsubame.session import cut, small, table, written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of these doc_ids."""
    ids = small(cut(ids.select("doc_id").distinct()))
    return docs.join(ids, docs["doc_id"] == ids["doc_id"], "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(weights, spark) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each linked group."""
    found = ngram_join.join_components(docs)
    return _without(docs, found.where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak of a benchmark item."""
    return _without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def shuffle_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; texts move once, to meet their places."""
    key = F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), F.octet_length("text"))
    # Copies of a row are told apart, so that each draws a place of its own.
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    marked = docs.select(key.alias("_key")).withColumn("_nth", nth)
    places = sharding.assign(marked, F.xxhash64("_key", "_nth"))
    # The row travels as one column, so none of its names can clash with a helper's.
    rows = docs.select(key.alias("_key"), F.struct("*").alias("_row")).withColumn("_nth", nth)
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(places, ["_key", "_nth"]).select(*kept, "shard", "slot")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("sharding", shuffle_shards),
]

# Training, hashed draws and random permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to shards."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
