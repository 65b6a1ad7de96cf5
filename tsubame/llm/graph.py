"""Connected components of an edge table by distributed union-find.

Every partition first contracts its own edges to stars (bounded memory, no shuffle of
whole groups); the stars are packed into tasks of ``LOCAL_EDGES`` nodes and contracted again;
then large-star and small-star steps alternate until nothing changes. Where one task
held all stars and could not fill its forest, nothing is left to do after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubame.session import cut

# Nodes that a partition holds at a time; n edges have 2 n nodes at most.
LOCAL_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(x), root(y)
            lo, hi = min(a, c), max(a, c)
            up.setdefault(lo, lo)
            up[hi] = lo
        if len(up) >= LOCAL_EDGES:
            yield stars()
            up.clear()
    if up:
        yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contract, "u long, v long").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) of every id on an edge; component is its smallest member.

    Edges with a null end and loops are ignored. Each returned id occurs once.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    e = cut(_stars(e))

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # One task is the last word only if it never hands out its forest halfway.
    tasks = 2 * e.count() // LOCAL_EDGES + 1
    e = cut(e.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
    now = state(e) if tasks > 1 else (0,)
    while now[0]:
        # Large-star: all larger neighbours go to the smallest one around.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: the node and its smaller neighbours go to the smallest one.
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = cut(_stars(e))
        if (new := state(e)) == now:
            break
        now = new
    ids = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = ids.select(F.col("component").alias("id"), "component").distinct()
    return ids.unionByName(roots)
