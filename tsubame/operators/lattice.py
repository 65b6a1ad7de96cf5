"""The lattice as a DataFrame, and its decoding by a fold: inspectable, for short segments.

Same results as the kernel. A segment of more than ``MAX_CHARS`` characters is refused by
``decode``, as a fold over a growing list is quadratic; it should go through the kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsubame.functions.charclass import TYPES, Classifier
from tsubame.sources.lexicon import Lexicon

MAX_CHARS = 400


def characters(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, ch, seg, n) of every character of the column seg."""
    return segments.select(*keys, "seg", F.char_length("seg").alias("n"), F.posexplode(F.split("seg", "")).alias("p", "ch")).where("ch <> ''")


def char_runs(segments: DataFrame, keys: list[str], classifier: Classifier | None = None) -> DataFrame:
    """(keys, p, ch, seg, n, type, run_end): the end of the same-type run at each character."""
    c = classifier or Classifier.default()
    typed = characters(segments, keys).withColumn("type", c.column(F.col("ch")))
    ahead = Window.partitionBy(*keys).orderBy("p")
    last = F.when(F.lead("type").over(ahead).eqNullSafe(F.col("type")), None).otherwise(F.col("p") + 1)
    return typed.withColumn("_last", last).withColumn("run_end", F.min("_last").over(ahead.rowsBetween(0, Window.unboundedFollowing))).drop("_last")


def prefix_matches(chars: DataFrame, lexicon: Lexicon, keys: list[str]) -> DataFrame:
    """(keys, p, len, entry_id) of every entry that starts at a character.

    Only lengths that some surface has are tried; the join is on the substring.
    """
    lengths = sorted(r[0] for r in lexicon.entries.select(F.char_length("surface")).distinct().collect())
    if not lengths:
        lengths = [0]
    tried = chars.withColumn("len", F.explode(F.array(*[F.lit(x) for x in lengths]))).where("p + len <= n")
    tried = tried.withColumn("surface", F.expr("substring(seg, p + 1, len)"))
    return tried.join(lexicon.entries.select("surface", "entry_id"), "surface").select(*keys, "p", "len", "entry_id")


def lattice(segments: DataFrame, lexicon: Lexicon, unknown: list[tuple], keys: list[str], classifier: Classifier | None = None) -> DataFrame:
    """Nodes (keys, start, end, unk, entry_id, left_id, right_id, word_cost, type).

    For unknown words entry_id is the number of the type.
    """
    chars = char_runs(segments, keys, classifier)
    found = prefix_matches(chars, lexicon, keys)
    known = found.join(lexicon.entries.select("entry_id", "left_id", "right_id", "cost"), "entry_id")
    known = known.select(*keys, F.col("p").alias("start"), (F.col("p") + F.col("len")).alias("end"), F.lit(0).alias("unk"), "entry_id", "left_id", "right_id", F.col("cost").cast("int").alias("word_cost"), F.lit(None).cast("string").alias("type"))
    flags = found.select(*keys, "p").distinct().withColumn("known", F.lit(True))

    def per_type(i: int) -> Column:
        return F.create_map(*[x for k, u in zip(TYPES, unknown, strict=True) for x in (F.lit(k), F.lit(u[i]))])[F.col("type")]

    p, end, size = F.col("p"), F.col("run_end"), per_type(2)
    grouped = F.when(size == 0, F.array(end)).otherwise(F.array(F.least(end, p + F.greatest(F.lit(2), size))))
    single = F.sequence(p + 1, F.least(end, p + F.greatest(F.lit(1), size)))
    ends = F.array_distinct(F.concat(F.when(per_type(1), grouped).otherwise(single), F.array(p + 1)))
    free = chars.join(flags, [*keys, "p"], "left").where(per_type(0) | F.col("known").isNull())
    number = F.create_map(*[x for i, k in enumerate(TYPES) for x in (F.lit(k), F.lit(i))])[F.col("type")]
    free = free.select(*keys, p.alias("start"), F.explode(ends).alias("end"), F.lit(1).alias("unk"), number.alias("entry_id"), per_type(3).alias("left_id"), per_type(4).alias("right_id"), per_type(5).cast("int").alias("word_cost"), "type")
    return known.unionByName(free)


def connection_costs(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(right_id, left_id) pairs with their cost; 0 where the matrix has none."""
    return pairs.join(matrix.withColumnRenamed("cost", "_c"), ["right_id", "left_id"], "left").withColumn("cost", F.coalesce("_c", F.lit(0)).cast("int")).drop("_c")


def decode(nodes: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, path) of the best path; path holds (start, end, unk, entry_id) structs.

    A fold over each segment's nodes in the order of ends and starts. Connection costs
    come along as one small map for each segment, of the id pairs that can meet there.
    """
    ends = nodes.select(*keys, F.col("end").alias("at"), "right_id").union(nodes.select(*keys, F.lit(0), F.lit(0))).distinct()
    starts = nodes.select(*keys, F.col("start").alias("at"), "left_id")
    last = nodes.groupBy(*keys).agg(F.max("end").alias("at")).withColumn("left_id", F.lit(0))
    meet = ends.join(starts.unionByName(last).distinct(), [*keys, "at"]).select(*keys, "right_id", "left_id").distinct()
    costs = meet.join(matrix, ["right_id", "left_id"]).groupBy(*keys)
    key = lambda r, k: r.cast("long") * 65_536 + k
    costs = costs.agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("right_id"), F.col("left_id")), F.col("cost").cast("int")))).alias("conn"))
    packed = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("end", "start", "unk", "entry_id", "left_id", "right_id", "word_cost"))).alias("nodes"))
    packed = packed.join(costs, keys, "left").withColumn("conn", F.coalesce("conn", F.create_map().cast("map<bigint,int>")))
    state = "array<struct<total:bigint,start:int,unk:int,entry_id:int,end:int,right_id:int,path:array<struct<start:int,end:int,unk:int,entry_id:int>>>>"
    best = (
        "array_min(transform(filter(acc, a -> a.end = {at}), a -> struct(a.total + coalesce(try_element_at(conn, cast(a.right_id as bigint) * 65536 + {left}), 0) as total,"
        " a.start as start, a.unk as unk, a.entry_id as entry_id, a.path as path)))"
    )
    new = best.format(at="x.start", left="x.left_id")
    fold = (
        f"aggregate(nodes, cast(array(struct(0, -1, 0, 0, 0, 0, array())) as {state}), (acc, x) -> concat(acc, transform(filter(array({new}), b -> b is not null),"
        " b -> struct(b.total + x.word_cost as total, x.start as start, x.unk as unk, x.entry_id as entry_id, x.end as end, x.right_id as right_id,"
        " concat(b.path, array(struct(x.start as start, x.end as end, x.unk as unk, x.entry_id as entry_id))) as path))))"
    )
    packed = packed.withColumn("n", F.expr("element_at(nodes, -1).end"))
    refused = F.raise_error(F.concat(F.lit(f"a segment has more than {MAX_CHARS} characters: "), F.col("n").cast("string")))
    packed = packed.withColumn("nodes", F.when(F.col("n") > MAX_CHARS, refused.cast("array<struct<end:int,start:int,unk:int,entry_id:int,left_id:int,right_id:int,word_cost:int>>")).otherwise(F.col("nodes")))
    done = packed.withColumn("acc", F.expr(fold))
    done = done.withColumn("b", F.expr(best.format(at="n", left="0")))
    return done.select(*keys, F.col("b.total").alias("total"), F.col("b.path").alias("path"))
