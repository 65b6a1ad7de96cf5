"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are dealt into source blocks by a hash. A random matrix, drawn with the
block sizes and the shard sizes as margins, says how many rows of each block go to
each shard, just as a uniform permutation would. Each block permutes its rows and
deals them out by that matrix; each shard permutes again what it receives. Only
counts reach the driver: blocks x shards of them, bounded by ``MAX_BLOCKS``.

Defined cases: a null text has size 1 and no checksum; null and repeated doc_ids are
rows like others; equal rows are interchangeable; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsubame.llm.draws import communication_matrix
from tsubame.session import cut, table

SHARDS = 16
SEED = 20_231
ROWS_PER_BLOCK = 1_000
MAX_BLOCKS = 16_384
SLICES_PER_SHARD = 4_096


def _sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def assign(rows: DataFrame, key: Column, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; shard sizes differ by one at most.

    ``key`` is a long hash of the whole row; ties are broken by nothing, as rows with
    equal keys are equal for the caller.
    """
    spark = rows.sparkSession
    keyed = cut(rows.withColumn("_k", key))
    total = keyed.count()
    blocks = max(1, min(MAX_BLOCKS, total // ROWS_PER_BLOCK))
    block = F.pmod(F.xxhash64(F.lit(seed), "_k"), F.lit(blocks)).cast("int")
    counts = dict(keyed.groupBy(block.alias("b")).count().collect())
    margins = [counts.get(b, 0) for b in range(blocks)]
    drawn = communication_matrix(np.random.default_rng(seed), margins, _sizes(total, shards))
    limits = np.cumsum(drawn, axis=1)
    ends = spark.createDataFrame([(b, limits[b].tolist()) for b in range(blocks)], "_b int, _ends array<bigint>")
    # First permutation, within blocks; the matrix row then deals the block out.
    order = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), "_k"), "_k")
    dealt = (
        keyed.withColumn("_b", block)
        .withColumn("_r", F.row_number().over(order))
        .join(F.broadcast(ends), "_b")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_r"))).cast("int"))
        .drop("_b", "_r", "_ends")
    )
    # Second permutation: each shard in the order of a fresh hash, slice by slice.
    per_shard = max(1, min(SLICES_PER_SHARD, total // shards // ROWS_PER_BLOCK))
    fresh = F.xxhash64(F.lit(seed + 2), "_k")
    dealt = cut(dealt.withColumn("_h", fresh).withColumn("_s", F.pmod(F.shiftright("_h", 16), F.lit(per_shard)).cast("int")))
    filled = {(r["shard"], r["_s"]): r["count"] for r in dealt.groupBy("shard", "_s").count().collect()}
    starts = [[0] * per_shard for _ in range(shards)]
    for s in range(shards):
        at = 0
        for i in range(per_shard):
            starts[s][i] = at
            at += filled.get((s, i), 0)
    offsets = spark.createDataFrame([(s, i, starts[s][i]) for s in range(shards) for i in range(per_shard)], "shard int, _s int, _at bigint")
    within = Window.partitionBy("shard", "_s").orderBy("_h", "_k")
    return (
        dealt.withColumn("_r", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_s"])
        .withColumn("slot", F.col("_at") + F.col("_r") - 1)
        .drop("_k", "_h", "_s", "_r", "_at")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, size, text_crc32, law, shard, slot and grown_shard."""
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    placed = assign(rows, F.xxhash64("doc_id", "size", "text_crc32"), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
