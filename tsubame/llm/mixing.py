"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash, and the blocks are put in a
random order. A target of t words takes the whole source floor(t / size) times and
the rest from its blocks in order: a block that fits goes whole, of another one every
document that still fits when its turn comes in a random order, until no document of
the source fits. Then the document of those looked at singly that comes closest to
what is left goes too, if it helps. The drawn blocks of all sources are divided among
the output shards by a tree: each node gives one half of its shards a multivariate
hypergeometric share of every source's blocks, so shards get disjoint runs of blocks
as a uniform shuffle would give; ``mix`` then shuffles each shard locally, in slices of
bounded size, by a random order of its copies. Documents are never cut.

Only block and source totals reach the driver: one row for each source, of which there
may be ``MAX_SOURCES``, and ``MAX_BLOCKS`` blocks besides one a source. No window or
join holds a whole source.

Defined cases: a null text has no words; a null source is a source of its own, after
all others; the empty string is another one; rows equal in doc_id, source and text
are taken together; an empty table gives an empty result; further columns of the
input are kept by ``mix`` and ignored by ``plan``. Names starting with ``_mix`` are
reserved.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsubame.llm.draws import multivariate
from tsubame.session import cut, shuffle_partitions, small, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SHARDS = 16
SEED = 7_001
DOCS_PER_BLOCK = 500
MAX_BLOCKS = 65_536
MAX_SOURCES = 1_000_000
ROWS_PER_SLICE, MAX_PARTS = 5_000, 65_536
WORD = r"[^\x20\x09-\x0D]+"
_GRID = 1 << 30


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS) -> list[float]:
    """Words wanted of each source: by weight, none above ``cap`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = rest / sum(w[i] for i in open_)
        full = [i for i in open_ if unit * w[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            rest -= out[i]
            open_.remove(i)
    return out


def split_tree(rng: np.random.Generator, quotas: list[int], shards: int) -> list[list[int]]:
    """For each shard, how many of each source's drawn blocks it gets."""
    if shards == 1:
        return [list(quotas)]
    half = shards // 2
    first = multivariate(rng, quotas, sum(quotas) * half // shards)
    second = [q - f for q, f in zip(quotas, first, strict=True)]
    return split_tree(rng, first, half) + split_tree(rng, second, shards - half)


def _keyed(docs: DataFrame) -> DataFrame:
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64("doc_id", "source", F.col("text").isNull(), F.crc32(F.col("text").cast("binary")), F.octet_length("text"))
    return docs.withColumns({"_mix_source": name, "_mix_size": size, "_mix_key": key})


def _block(blocks: Column, seed: int) -> Column:
    at = F.pmod(F.xxhash64(F.lit(seed), "_mix_key"), F.lit(_GRID))
    return F.shiftright(at * blocks, 30).cast("int")


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **rules: object) -> DataFrame:
    """Every document's size, source_size, target, taken words and shard of each copy."""
    narrow = cut(_keyed(docs).select("doc_id", "_mix_source", "_mix_size", "_mix_key"))
    return _draw(narrow, narrow, shards, seed, rules).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.size("_mix_shards") * F.col("_mix_size")).cast("long").alias("taken"),
        F.col("_mix_shards").alias("shards"),
    )


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **rules: object) -> DataFrame:
    """The mixture: each document's row as often as it is taken, with columns as in ``docs``."""
    keyed = _keyed(docs)
    narrow = cut(keyed.select("_mix_source", "_mix_size", "_mix_key"))
    copies = _draw(keyed, narrow, shards, seed, rules).select("*", F.posexplode("_mix_shards").alias("_mix_copy", "_mix_shard"))
    # The local shuffle: copies meet by shard and range of a random order, and stand in that order.
    slices = max(1, -(-narrow.count() // (ROWS_PER_SLICE * shards)))
    placed = copies.withColumn("_mix_order", F.xxhash64(F.lit(seed + 2), "_mix_key", "_mix_copy"))
    placed = placed.withColumn("_mix_slice", F.pmod(F.shiftright("_mix_order", 32), F.lit(slices)))
    parts = min(MAX_PARTS, max(shards * slices, shuffle_partitions(docs.sparkSession)))
    placed = placed.repartition(parts, "_mix_shard", "_mix_slice")
    return placed.sortWithinPartitions("_mix_shard", "_mix_slice", "_mix_order", "_mix_key").select(*[F.col(f"`{c}`") for c in docs.columns])


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), "_mix_key")


def _fitted(narrow: DataFrame, edge: list[tuple[int, int, float]], seed: int) -> DataFrame:
    """The documents of one block a source, in random order, each with whether it fits in what is left of the quota."""
    quota = small(narrow.sparkSession.createDataFrame(edge, "_mix_no int, _mix_block int, _mix_quota double"))
    unit = narrow.join(quota, ["_mix_no", "_mix_block"]).groupBy("_mix_no", "_mix_key", "_mix_quota").agg(F.sum("_mix_size").alias("unit"))
    docs = F.array_sort(F.collect_list(F.struct(_order(seed).alias("at"), F.col("_mix_key").alias("key"), "unit"))).alias("docs")
    none = F.array().cast("array<struct<_mix_key:bigint,_mix_unit:bigint,_mix_fits:boolean>>")

    def step(acc: Column, d: Column) -> Column:
        fits = d["unit"] <= acc["left"]
        one = F.struct(d["key"].alias("_mix_key"), d["unit"].alias("_mix_unit"), fits.alias("_mix_fits"))
        return F.struct(F.when(fits, acc["left"] - d["unit"]).otherwise(acc["left"]).alias("left"), F.concat(acc["out"], F.array(one)).alias("out"))

    out = F.aggregate("docs", F.struct(F.col("_mix_quota").alias("left"), none.alias("out")), step, lambda acc: acc["out"])
    return cut(unit.groupBy("_mix_no", "_mix_quota").agg(docs).select("_mix_no", F.inline(out)))


def _chosen(spark: SparkSession, tried: list[DataFrame], rest: list[float], seed: int) -> DataFrame:
    """Those that fit, and of the others the one closest to what is left of each source, if it helps."""
    if not tried:
        return spark.createDataFrame([], "_mix_no int, _mix_key bigint, _mix_chosen boolean")
    left = spark.createDataFrame(list(enumerate(rest)), "_mix_no int, _mix_left double")
    unit = reduce(DataFrame.unionByName, tried).join(small(left), "_mix_no")
    gap = F.abs(F.col("_mix_unit") - F.col("_mix_left"))
    closest = F.row_number().over(Window.partitionBy("_mix_no").orderBy("_mix_fits", gap, _order(seed), "_mix_key"))
    unit = unit.withColumn("_mix_rank", closest)
    chosen = unit.where(F.col("_mix_fits") | ((F.col("_mix_rank") == 1) & (gap < F.col("_mix_left"))))
    return chosen.select("_mix_no", "_mix_key", F.lit(True).alias("_mix_chosen"))


def _draw(rows: DataFrame, narrow: DataFrame, shards: int, seed: int, rules: dict) -> DataFrame:
    """``rows`` with _mix_total, _mix_target and _mix_shards, one shard for each copy."""
    spark = rows.sparkSession
    totals = narrow.groupBy("_mix_source").agg(F.sum("_mix_size").alias("words"), F.count("*").alias("n"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] == "n", r[0]))
    words, want = [r["words"] for r in found], targets([r["words"] for r in found], **rules)
    total = max(1, sum(r["n"] for r in found))
    blocks = [max(1, min(r["n"] // DOCS_PER_BLOCK, MAX_BLOCKS * r["n"] // total)) for r in found]
    sources = spark.createDataFrame(
        [(r[0], i, blocks[i], words[i], want[i]) for i, r in enumerate(found)], "_mix_source string, _mix_no int, _mix_blocks int, _mix_total bigint, _mix_target double"
    )
    sources = small(sources)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(sources, "_mix_source").withColumn("_mix_block", _block(F.col("_mix_blocks"), seed))

    narrow = cut(placed(narrow))
    least = F.min(F.when(F.col("_mix_size") > 0, F.col("_mix_size")))
    load = {(r[0], r[1]): (r[2], r[3]) for r in narrow.groupBy("_mix_no", "_mix_block").agg(F.sum("_mix_size"), least).collect()}
    runs, rest, ahead, parts, tried = [], [], [], set(), []
    for i in range(len(found)):
        order = np.random.default_rng((seed, i)).permutation(blocks[i]).tolist()
        passes, left = (0, 0.0) if words[i] == 0 else divmod(want[i], words[i])
        runs.append(order * int(passes))
        rest.append(left)
        ahead.append(iter(order if left > 0 else ()))
    waiting = range(len(found))
    while waiting:
        edge = []
        for i in waiting:
            for b in ahead[i]:
                size, smallest = load.get((i, b), (0, None))
                if size <= rest[i]:
                    rest[i] -= size
                    runs[i].append(b)
                elif i not in parts or smallest <= rest[i]:
                    # A source's first block that does not fit is looked into in any case.
                    parts |= {i, (i, b)}
                    runs[i].append(b)
                    edge.append((i, b, rest[i]))
                    break
        waiting = [i for i, _, _ in edge]
        if edge:
            tried.append(_fitted(narrow, edge, seed))
            for r in tried[-1].where("_mix_fits").groupBy("_mix_no").agg(F.sum("_mix_unit")).collect():
                rest[r[0]] -= r[1]
    copies: dict[tuple[int, int], list[int]] = {}
    at = [0] * len(runs)
    for shard, share in enumerate(split_tree(np.random.default_rng(seed), [len(r) for r in runs], shards)):
        for i, n in enumerate(share):
            for b in runs[i][at[i] : at[i] + n]:
                copies.setdefault((i, b), []).append(shard)
            at[i] += n
    table_ = []
    for (i, b), to in copies.items():
        last = to[-1] if (i, b) in parts else None
        table_.append((i, b, to[:-1] if last is not None else to, last))
    drawn = small(spark.createDataFrame(table_, "_mix_no int, _mix_block int, _mix_to array<int>, _mix_last int"))
    chosen = cut(_chosen(spark, tried, rest, seed))
    out = placed(rows).join(drawn, ["_mix_no", "_mix_block"], "left").join(small(chosen), ["_mix_no", "_mix_key"], "left")
    last = F.when(F.col("_mix_chosen") & F.col("_mix_last").isNotNull(), F.array("_mix_last")).otherwise(F.array().cast("array<int>"))
    return out.withColumn("_mix_shards", F.concat(F.coalesce("_mix_to", F.array().cast("array<int>")), last))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))

