"""Exact top-k inner products over norm-sorted vectors with residual bounds.

Vectors become integers floor(256 * x). All are rotated by the right singular basis of
their Gram matrix (summed over all rows, a dims x dims matrix), so the first rotated
coordinates carry most of the length. Vectors lie in blocks of descending length. For
a query q and a vector v the score is at most |q| |v|, and after the first coordinates
at most their partial sum plus |q rest| |v rest| (Cauchy-Schwarz). The longest vectors
run first and give every query its threshold; a query then travels only to the blocks
whose longest vector can still reach it, a run of blocks from the first on, and a block
only to the groups of queries that need it. Inside, a block stops as soon as the first
bound falls below the query's k-th best score; what the second bound leaves is scored
in integers. Where all lengths are alike no block can be spared, and every query meets
every block, in tasks of bounded size.

Defined cases: vectors that are null or hold null, NaN or infinite components take no
part, neither as queries nor as candidates; shorter vectors count as padded with
zeros; ties go to the smaller vec_id; a query row never meets itself; rows that repeat a
vec_id are queries and candidates of their own; an empty table gives an empty result.
Extra columns are ignored. A row without vec_id is neither query nor candidate.
Components may have any finite size below 2^480 (a vector beyond, which only an array of
doubles can hold, takes no part): where a squared length leaves 62 bits all scores are
computed in unbounded integers, and ranked so; a score that a long cannot hold is null
in the result, at its right rank. The floating bounds carry a slack, so rounding never
prunes a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsubame.session import cut, shuffle_partitions, small, table

TOP = 5
SCALE = 256
EVERY = 50
HEAD_ROWS = 4_096
BLOCK_ROWS = 8_192
QUERY_ROWS = 2_048
MAX_RANGES = 1_024
LEAD = 16
SLACK = 1e-6

# Squared lengths below this keep all inner products within a long.
NARROW = 2.0**62
LARGEST = 2.0**480
# Wide scores are ranked as digits of this base, the first of them signed.
DIGIT_BITS, DIGITS = 60, 18

_OUT = "q long, v long, vec_id long, score long, digits array<long>, about double"
_SCHEMA = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("digits", pa.list_(pa.int64())), ("about", pa.float64())])


def _matrix(col: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integral doubles, padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dims))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _gram(dims: int) -> Callable:
    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column(0), dims)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(dims), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return run


def integers(m: np.ndarray, wide: bool) -> np.ndarray:
    """Integral doubles as longs, or exactly at any size."""
    return np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) if wide else m.astype(np.int64)


def digits(score: int) -> list[int]:
    """Digits whose lexical order is the order of the numbers."""
    out = []
    for _ in range(DIGITS - 1):
        score, low = divmod(score, 1 << DIGIT_BITS)
        out.append(low)
    return [score, *reversed(out)]


def search(queries: np.ndarray, qid: np.ndarray, floor_: np.ndarray, vectors: np.ndarray, vid: np.ndarray, ids: np.ndarray, basis: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """Top k of each query among ``vectors`` that can still reach its floor score.

    ``queries`` and ``vectors`` hold longs or, where scores may leave them, objects;
    ``qid`` and ``vid`` number the rows; ties go to the smaller of ``ids``, then row.
    """
    fq, fv = queries.astype(np.float64), vectors.astype(np.float64)
    kind = queries.dtype
    length = np.linalg.norm(fv, axis=1)
    order = np.argsort(-length, kind="stable")
    vectors, vid, ids, fv, length = vectors[order], vid[order], ids[order], fv[order], length[order]
    rq, rv = fq @ basis, fv @ basis
    lead = min(LEAD, basis.shape[1])
    rest_q, rest_v = np.linalg.norm(rq[:, lead:], axis=1), np.linalg.norm(rv[:, lead:], axis=1)
    qlen = np.linalg.norm(fq, axis=1)
    out = []
    for i in range(len(qid)):
        bar = floor_[i]
        best, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        for a in range(0, len(vid), 512):
            slack = SLACK * (1 + qlen[i] * length[a])
            if qlen[i] * length[a] + slack < bar:
                break
            b = slice(a, a + 512)
            bound = rv[b, :lead] @ rq[i, :lead] + rest_v[b] * rest_q[i]
            at = a + np.flatnonzero((bound + slack >= bar) & (vid[b] != qid[i]))
            if not len(at):
                continue
            best = np.concatenate([best, at])
            scores = np.concatenate([scores, vectors[at] @ queries[i]])
            top = np.lexsort((vid[best], ids[best], -scores))[:k]
            best, scores = best[top], scores[top]
            if len(best) == k:
                bar = max(bar, float(scores[-1]))
        out += [(int(qid[i]), int(vid[j]), int(ids[j]), int(s)) for j, s in zip(best, scores, strict=True)]
    return out


def _search(dims: int, basis: np.ndarray, k: int, wide: bool) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            floor_ = left.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy()
            qid, vid, ids = left.column("row").to_numpy(), right.column("row").to_numpy(), right.column("vec_id").to_numpy()
            x, y = (integers(_matrix(t.column("x"), dims), wide) for t in (left, right))
            rows = search(x, qid, floor_, y, vid, ids, basis, k)
        exact = [r[3] if -(1 << 63) <= r[3] < 1 << 63 else None for r in rows]
        order = [digits(r[3]) if wide else None for r in rows]
        return pa.Table.from_arrays([*(pa.array([r[j] for r in rows], pa.int64()) for j in range(3)), pa.array(exact, pa.int64()), pa.array(order, pa.list_(pa.int64())), pa.array([float(r[3]) for r in rows], pa.float64())], schema=_SCHEMA)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    # Digits are there for all scores or for none.
    order = Window.partitionBy("q").orderBy(F.desc("digits"), F.desc("score"), "vec_id", "v")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(used: DataFrame, total: int) -> tuple[DataFrame, np.ndarray]:
    """``used`` with its block ``vb``, numbered by falling length, and the longest length of each block.

    Blocks are ranges of lengths; a range of more rows, as equal lengths make it, is
    divided by a hash.
    """
    spark = used.sparkSession
    ranges = min(MAX_RANGES, max(1, shuffle_partitions(spark), -(-total // BLOCK_ROWS)))
    edges = sorted(set(used.stat.approxQuantile("norm", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    used = used.withColumn("r", _between(F.col("norm"), edges, 0, len(edges)))
    size = {r["r"]: (r["n"], r["top"]) for r in used.groupBy("r").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    first, parts, tops = {}, {}, []
    for r in sorted(size, reverse=True):
        n, top = size[r]
        first[r], parts[r] = len(tops), max(1, -(-n // (2 * BLOCK_ROWS)))
        tops += [top] * parts[r]
    plan = spark.createDataFrame([(r, first[r], parts[r]) for r in first], "r int, first int, parts int")
    used = used.join(small(plan), "r").withColumn("vb", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
    return used.drop("r", "first", "parts"), np.sqrt(np.array(tops, np.float64))


def _between(x: Column, edges: list[float], lo: int, hi: int) -> Column:
    """Number of edges below x, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x > edges[mid], _between(x, edges, mid + 1, hi)).otherwise(_between(x, edges, lo, mid))


def top_k(rows: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best partners of every query row."""
    spark = rows.sparkSession
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = fine & ~F.exists("embedding", lambda x: F.abs(x) >= LARGEST)
    # Beyond 2^53 every double is a whole number.
    floor_ = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    ints = F.transform("embedding", lambda x: floor_(x.cast("double") * SCALE))
    used = rows.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    used = cut(used.withColumns({"norm": norm, "row": F.monotonically_increasing_id()}))
    dims, total, longest = used.agg(F.max(F.size("x")), F.count("*"), F.max("norm")).first()
    dims, wide = max(1, dims or 1), (longest or 0) >= NARROW
    parts = used.select("x").mapInArrow(_gram(dims), "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros((dims, dims))
    for i, j, v in sums:
        gram[i, j] = v
    basis = np.linalg.svd(gram)[2].T
    queries = used.where("asks").select("row", "vec_id", "x", "norm")
    groups = max(1, -(-queries.count() // QUERY_ROWS))

    def against(left: DataFrame, right: DataFrame) -> DataFrame:
        # Aliases give both sides columns of their own.
        left = left.select(*[F.col(c).alias(c) for c in ("qb", "vb", "row", "x", "floor")])
        right = right.select(*[F.col(c).alias(c) for c in ("qb", "vb", "row", "vec_id", "x")])
        return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_search(dims, basis, k, wide), _OUT)

    # The longest vectors give every query a first threshold.
    every = F.sequence(F.lit(0), F.lit(groups - 1))
    head = used.orderBy(F.desc("norm"), "row").limit(HEAD_ROWS).select("row", "vec_id", "x", F.lit(0).alias("vb"), F.explode(every).alias("qb"))
    asked = queries.withColumns({"floor": F.lit(None).cast("double"), "vb": F.lit(0), "qb": F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")})
    first = _ranked(against(asked, head), k)
    floors = first.where(F.col("rank") == k).select(F.col("q").alias("row"), F.col("about").alias("floor"))
    vectors, tops = _blocks(used, total)
    # Length that a vector needs to reach the threshold, and the last block that holds one.
    asked = queries.join(floors, "row", "left")
    need = F.col("floor") / F.sqrt(F.col("norm").cast("double")) * (1 - SLACK) - SLACK
    reach = F.coalesce(F.when(F.col("norm") > 0, need), F.lit(-1.0))
    asked = cut(asked.withColumn("blocks", _reached(reach, tops)))
    # Groups hold queries of like reach, so a block goes to few groups.
    ranges = min(MAX_RANGES, groups)
    edges = asked.stat.approxQuantile("blocks", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    asked = asked.withColumn("g", _between(F.col("blocks").cast("double"), sorted(set(edges)), 0, len(set(edges))))
    size = {r["g"]: (r["n"], r["most"]) for r in asked.groupBy("g").agg(F.count("*").alias("n"), F.max("blocks").alias("most")).collect()}
    start, spread, most = {}, {}, []
    for g in sorted(size, reverse=True):
        start[g], spread[g] = len(most), max(1, -(-size[g][0] // (2 * QUERY_ROWS)))
        most += [size[g][1]] * spread[g]
    to = small(spark.createDataFrame([(g, start[g], spread[g]) for g in start], "g int, start int, spread int"))
    left = asked.join(to, "g").withColumn("qb", (F.col("start") + F.pmod(F.xxhash64("row"), F.col("spread"))).cast("int"))
    left = left.where("blocks > 0").withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    needs = [(b, len(most) - int(np.searchsorted(sorted(most), b, "right"))) for b in range(len(tops))]
    wanted = small(spark.createDataFrame([x for x in needs if x[1]], "vb int, n int"))
    right = vectors.join(wanted, "vb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = against(left, right)
    names = queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
    return _ranked(found, k).join(names, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _reached(length: Column, tops: np.ndarray) -> Column:
    """How many blocks, from the first on, have a vector of this length at least."""
    rising = sorted(set(tops.tolist()))
    at_least = [int((tops >= x).sum()) for x in rising] + [0]
    below = _between(length, rising, 0, len(rising))
    return F.get(F.lit(at_least), below).cast("int")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS q, c.n AS v, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, v) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, v) <= 5
"""
