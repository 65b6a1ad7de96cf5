"""k-means by Sort-means: exact integer rounds that skip centroids by the triangle inequality.

A vector's components become integers floor(1024 * x). In each round the centroids are
sorted once by their distance from every other centroid (k lists of k). A vector starts
at the centroid it had before, at distance d, and walks that centroid's list; whatever
stands strictly beyond 2 d cannot be nearer, nor as near, and the walk ends there. In
squared integers: D > 4 d, with no rounding. Centroids become the floor of sum / count.

Vectors travel in packed blocks. A round maps the blocks of the round before to new
assignments (no shuffle) and sums them by cluster and component inside the tasks; what is
shuffled, and what the driver sees, is k times dims sums a task. The blocks of the last two
rounds are persisted on the executors; a lost block is computed again from its
predecessors, and the result is written to the shared folder.

Defined cases: vectors that are null, hold null, NaN or infinite components or have
another number of components take no part; with fewer than k vectors there are as many
centroids; an empty table gives an empty result; a vector without vec_id is assigned and
counted but cannot be a first centroid; rows that repeat a vec_id are vectors of their
own (of equal hashes the smaller vector comes first as a centroid); ties go to the
smaller cluster number. Components of any finite size are exact: beyond 2^17 a vector
is computed in unbounded integers. A distance or sum that a long cannot hold is null.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.session import arrow_rows, small, spread, table, written

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
BLOCK_ROWS = 1_024
BLOCKS_PER_BATCH = 8
# Up to this size of an integer component, 64 squared differences fit into a long.
NARROW = 1 << 27
LONG = 1 << 63
# Sums travel as digits of this base, so decimals hold them at any size.
LIMB = 1 << 62

_BLOCK = "ids array<long>, x binary, cluster binary"
_SUMS = "cluster int, d int, limb int, s decimal(38,0)"


def whole(x: float) -> int:
    """floor(SCALE * x), exact where the product leaves a double."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def ordered(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid: all centroids by squared distance D from it, and ceil(D / 4)."""
    c = np.array(centroids, object)
    k = len(c)
    gap = np.array([[-(-int(((a - b) ** 2).sum()) // 4) for b in c] for a in c], object).reshape(k, k)
    order = np.array([sorted(range(k), key=lambda j, i=i: (gap[i][j], j)) for i in range(k)], np.int64).reshape(k, k)
    return order, np.take_along_axis(gap, order, axis=1)


def assign(v: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``v``, walking from its cluster before.

    D > 4 d exactly where ceil(D / 4) > d, which does not leave a long.
    """
    cluster, distance = before.copy(), np.zeros(len(v), v.dtype)
    for c in range(len(centroids)):
        at = np.flatnonzero(before == c)
        if not len(at):
            continue
        first = ((v[at] - centroids[c]) ** 2).sum(axis=1)
        best, low = np.full(len(at), c), first.copy()
        for j, far in zip(order[c], quarter[c], strict=True):
            near = np.flatnonzero(far <= first)
            if not len(near):
                break
            if j == c:
                continue
            d = ((v[at[near]] - centroids[j]) ** 2).sum(axis=1)
            won = (d < low[near]) | ((d == low[near]) & (j < best[near]))
            low[near[won]], best[near[won]] = d[won], j
        cluster[at], distance[at] = best, low
    return cluster, distance


def parts(blob: bytes, dtype: str, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) of a block: most in longs, those of huge components as objects."""
    x = np.frombuffer(blob, dtype).reshape(-1, dims)
    wide = (np.abs(x) >= NARROW // SCALE).any(axis=1)
    if not wide.all():
        yield np.flatnonzero(~wide), np.floor(x[~wide].astype(np.float64) * SCALE).astype(np.int64)
    if wide.any():
        yield np.flatnonzero(wide), np.array([[whole(float(y)) for y in r] for r in x[wide]], object)


def _pack(dtype: str) -> Callable:
    """(vec_id, embedding) rows as blocks; all start at cluster 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype)
                ids = pa.array([b.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.record_batch([ids, pa.array([x.tobytes()], pa.binary()), pa.array([bytes(2 * b.num_rows)], pa.binary())], ["ids", "x", "cluster"])

    return run


class Nearest:
    """The nearest of these centroids for the blocks of a batch."""

    def __init__(self, centroids: list[list[int]], dtype: str) -> None:
        self.dtype, self.dims = dtype, len(centroids[0])
        self.exact = np.array(centroids, object)
        self.order, self.quarter = ordered(centroids)
        # Longs hold all distances if the centroids are narrow, too.
        self.narrow = max(abs(x) for c in centroids for x in c) < NARROW

    def __call__(self, b: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
        longs = (self.exact.astype(np.int64), self.order, self.quarter.astype(np.int64)) if self.narrow else None
        for blob, old in zip(b.column("x").to_pylist(), b.column("cluster").to_pylist(), strict=True):
            old = np.frombuffer(old, np.uint16).astype(np.int64)
            cluster, distance = np.zeros(len(old), np.int64), [0] * len(old)
            for at, v in parts(blob, self.dtype, self.dims):
                if v.dtype == object or longs is None:
                    cluster[at], d = assign(v.astype(object), old[at], self.exact, self.order, self.quarter)
                else:
                    cluster[at], d = assign(v, old[at], *longs)
                for i, x in zip(at.tolist(), d.tolist(), strict=True):
                    distance[i] = x
            yield cluster, distance


def _assign(nearest: Nearest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [c.astype(np.uint16).tobytes() for c, _ in nearest(b)]
            yield pa.record_batch([b.column("ids"), b.column("x"), pa.array(found, pa.binary())], ["ids", "x", "cluster"])

    return run


def _rows(nearest: Nearest) -> Callable:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, (cluster, distance) in zip(b.column("ids"), nearest(b), strict=True):
                d = pa.array([x if x < LONG else None for x in distance], pa.int64())
                yield pa.record_batch([ids.values, pa.array(cluster, pa.int32()), d], ["vec_id", "cluster", "distance"])

    return run


def _sums(dtype: str, dims: int, k: int) -> Callable:
    """Per task: count (d = -1) and component sums of every cluster, in digits."""
    schema = pa.schema([("cluster", pa.int32()), ("d", pa.int32()), ("limb", pa.int32()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for b in batches:
            for blob, cluster in zip(b.column("x").to_pylist(), b.column("cluster").to_pylist(), strict=True):
                cluster = np.frombuffer(cluster, np.uint16)
                for at, v in parts(blob, dtype, dims):
                    for c in np.unique(cluster[at]).tolist():
                        mine = v[cluster[at] == c]
                        total[c] += mine.sum(axis=0).astype(object)
                        count[c] += len(mine)
        out = []
        for c in np.flatnonzero(count).tolist():
            out.append((c, -1, 0, int(count[c])))
            for d, x in enumerate(total[c]):
                sign, rest, limb = (1 if x >= 0 else -1), abs(int(x)), 0
                while rest:
                    rest, digit = divmod(rest, LIMB)
                    out.append((c, d, limb, sign * digit))
                    limb += 1
        yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _means(blocks: DataFrame, dtype: str, centroids: list[list[int]]) -> list[list[int]]:
    """New centroids; at most k * (dims + 1) * digits rows reach the driver."""
    dims, k = len(centroids[0]), len(centroids)
    sums = blocks.select("x", "cluster").mapInArrow(_sums(dtype, dims, k), _SUMS).groupBy("cluster", "d", "limb").agg(F.sum("s").alias("s")).collect()
    count = {r["cluster"]: int(r["s"]) for r in sums if r["d"] < 0}
    total = [[0] * dims for _ in range(k)]
    for r in sums:
        if r["d"] >= 0:
            total[r["cluster"]][r["d"]] += int(r["s"]) * LIMB ** r["limb"]
    return [[x // count[c] for x in total[c]] if c in count else centroids[c] for c in range(k)]


def cluster_vectors(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    if not 0 < k < 1 << 16:
        raise ValueError(f"{k} clusters are outside 1 to 65,535")
    spark = rows.sparkSession
    fine = (F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    dtype = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    kept = rows.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if dtype == "<f4" else "array<double>").alias("embedding"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").select(digest.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    centroids = [[whole(x) for x in r["embedding"]] for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    arrow_rows(spark, BLOCK_ROWS)
    blocks = spread(kept).mapInArrow(_pack(dtype), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    # Blocks are large already; a batch takes a few of them.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_PER_BATCH))
    for _ in range(rounds):
        moved = blocks.mapInArrow(_assign(Nearest(centroids, dtype)), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        centroids = _means(moved, dtype, centroids)
        blocks.unpersist()
        blocks = moved
    out = written(blocks.mapInArrow(_rows(Nearest(centroids, dtype)), "vec_id long, cluster int, distance long"))
    blocks.unpersist()
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = out.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), exact).alias("s")).collect()
    fits = lambda x: int(x) if x is not None and x < LONG else None
    sums = {r["cluster"]: r["s"] for r in per}
    all_ = None if None in sums.values() else sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame([(c, fits(s), fits(all_), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(small(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


_ROUND = """
a{r} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT n, vec_id, c, CAST(list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN m{r} m) GROUP BY n),
"""
_MEANS = """
m{next} AS MATERIALIZED (SELECT m.c, coalesce(f.q, m.q) AS q FROM m{r} m LEFT JOIN (
  SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS q FROM (
    SELECT c, i, sum(x) AS s, count(*) AS k FROM (SELECT a.c, unnest(v.q) AS x, unnest(range(len(v.q))) AS i FROM v JOIN a{r} a USING (n)) GROUP BY c, i) GROUP BY c) f USING (c)),
"""

ORACLE = (
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT 8),
"""
    + "".join(_ROUND.format(r=r) + (_MEANS.format(r=r, next=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    + f"""
z AS (SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, m.q FROM a{ROUNDS} a JOIN m{ROUNDS} m USING (c))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM z
"""
)
