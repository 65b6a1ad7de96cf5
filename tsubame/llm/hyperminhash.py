"""MinHash near-dedup on HyperMinHash registers: compressed minima, banding, exact verification.

1. A set's shingle hashes are dealt to 128 buckets by their first bits. Of each bucket's
   least hash a register keeps the number of leading zeros (6 bits) and the ``MANTISSA``
   bits behind the first one: 16 bits where the minimum had 57. An empty bucket borrows
   the register of another one, in an order fixed for the bucket, so sets of any size
   have full signatures and two registers agree with the probability of the Jaccard
   similarity. Texts with equal sets form a class and go on as one.
2. ``BANDS`` bands of ``ROWS`` registers: two sets of similarity 0.85 meet in one with a
   probability above 0.9999995.
3. Of all that meet in a band each is first paired with the member that meets the most
   others, in whatever band: the text that near copies were made from. What is linked
   needs no further pair. Where up to ``LARGE`` meet, members of different components
   are then compared by registers, inside one task, and only likely pairs leave it. Where
   more do and differ, they are dealt again by two bands at once, then by three (two sets
   of similarity 0.85 agree in three bands with a probability of 0.9999); what still is a
   large group of several components is compared in pairs of blocks of bounded size. No
   group is dropped or cut.
4. A candidate pair must pass the length filter; its similarity as estimated from equal
   registers, less those expected to collide by chance, must reach the threshold less
   ``SLACK``, about six standard deviations; and parity sketches, which bound the
   difference of two sets from below, must admit it. A pair that meets in several bands is
   made in the first one only. What passes is verified on full sets. Linked classes are
   united by distributed union-find.

Defined cases: a text with fewer than ``k`` words is one shingle; a null or empty text,
or one without words, has none and is linked with nothing; a class whose rows have no
doc_id is linked by equal sets only, has no component_id and is kept; rows that share a
doc_id are judged by their own texts; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.llm import textvec as tv
from tsubame.llm.graph import components
from tsubame.llm.ngram_join import Sketches, _verify, apart, distinct_sets, fingerprint, overlap, sketch
from tsubame.session import arrow_rows, cut, small, table, written

K = 3
PERCENT = 85
BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS = 25, 5
SLACK = 0.28
LARGE = 2_000
LEVELS = 3
BLOCK = 1_000
SALT_PAIRS = 256
TEXT_ROWS = 1_024
PAIR_ROWS = 128
SEEN = 500_000

# Where an empty bucket borrows: column j tries all other buckets in an order of its own.
_BORROW = np.stack([np.random.default_rng(j).permutation(np.delete(np.arange(BUCKETS), j)) for j in range(BUCKETS)], axis=1)


def compress(least: np.ndarray) -> np.ndarray:
    """Registers of bucket minima (bucket bits shifted out): leading zeros + 1, then mantissa bits."""
    x = least.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> tv.U(s)
    zeros = 64 - np.bitwise_count(x).astype(np.uint64)
    behind = np.where(zeros < 63, (least << np.minimum(zeros, tv.U(62))) << tv.U(1), tv.U(0)) >> tv.U(64 - MANTISSA)
    return ((np.minimum(zeros, tv.U(62)) + tv.U(1)) << tv.U(MANTISSA) | behind).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each sorted, non-empty set of 64-bit hashes."""
    if not sets:
        return np.zeros((0, BUCKETS), np.uint16)
    size = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    bucket = np.repeat(np.arange(len(sets)) * BUCKETS, size) + (h >> tv.U(64 - BUCKET_BITS)).astype(np.int64)
    # Sorted sets: the first hash of a bucket is its least.
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    full = np.zeros(len(sets) * BUCKETS, np.uint16)
    full[bucket[first]] = compress(h[first] << tv.U(BUCKET_BITS))
    full = full.reshape(-1, BUCKETS)
    out = full.copy()
    i, j = np.nonzero(full == 0)
    for t in range(BUCKETS - 1):
        if not len(i):
            break
        out[i, j] = full[i, _BORROW[t][j]]
        void = out[i, j] == 0
        i, j = i[void], j[void]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of each row of registers."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=tv.U), (len(regs), 1))
    for r in range(ROWS):
        key = tv.mix(key * tv.odd(7) + regs[:, r * BANDS : (r + 1) * BANDS].astype(tv.U) + tv.U(1))
    return key


@cache
def _cells(level: int) -> np.ndarray:
    """Probability of each register value for a bucket of a set of 2 ** (level / 2) elements."""
    zeros = np.repeat(np.arange(62), 1 << MANTISSA)
    place = np.tile(np.arange(1 << MANTISSA), 62) / (1 << MANTISSA)
    low = 0.5 ** (zeros + 1) * (1 + place)
    high = low + 0.5 ** (zeros + 1 + MANTISSA)
    none = lambda x: np.exp(2 ** (level / 2) * np.log1p(-x / BUCKETS))
    return none(low) - none(high)


@cache
def _chance(a: int, b: int) -> float:
    return float(_cells(a) @ _cells(b)) * BUCKETS


def estimate(rx: np.ndarray, ry: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard estimate of aligned register rows: equal registers less expected chance collisions."""
    same = (rx == ry).sum(axis=1)
    level = lambda n: np.round(2 * np.log2(n)).astype(int).tolist()
    chance = np.array([_chance(min(a, b), max(a, b)) for a, b in zip(level(nx), level(ny), strict=True)])
    return (same - chance) / BUCKETS


def likely(rx: np.ndarray, ry: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which aligned pairs pass the length filter and the estimate."""
    out = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    out[out] = estimate(rx[out], ry[out], nx[out], ny[out]) >= percent / 100 - SLACK
    return out


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _signatures(k: int) -> Callable:
    """(doc_id, n, fp, regs, sketch) of each text; the last two only once for each set that a task has seen lately."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("regs", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = tv.Tables(), set()
        for b in batches:
            ids = b.column(0).cast(pa.int64())
            for i, sets in distinct_sets(b.column(1), k, t):
                fp = [fingerprint(s) for s in sets]
                regs: list[bytes | None] = [None] * len(sets)
                odd: list[np.ndarray | None] = [None] * len(sets)
                fresh = []
                for j, f in enumerate(fp):
                    if len(sets[j]) and f not in seen:
                        seen.add(f)
                        fresh.append(j)
                for j, r in zip(fresh, registers([sets[j] for j in fresh]), strict=True):
                    regs[j], odd[j] = r.tobytes(), sketch(sets[j])
                if len(seen) > SEEN:
                    seen.clear()
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.record_batch([ids.slice(i, len(sets)), n, pa.array(fp, pa.int64()), pa.array(regs, pa.binary()), pa.array(odd, pa.list_(pa.int64()))], schema=schema)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, bands) of every set in the groups of one band more than ``bands`` has."""
    bit = 1 << np.arange(BANDS, dtype=np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        keys, fp, has = band_keys(_matrix(b.column(1))), b.column(0).to_numpy(), b.column(2).to_numpy()
        row, band = np.nonzero((has[:, None] & bit) == 0)
        mask = has[row] | bit[band]
        # Order of bands does not matter: keys of all bands of the mask are summed.
        key = np.zeros(len(row), tv.U)
        for j in range(BANDS):
            of = (mask >> j) & 1 == 1
            key[of] += keys[row[of], j]
        yield pa.record_batch([pa.array(tv.mix(key).view(np.int64)), pa.array(fp[row]), pa.array(mask)], ["key", "fp", "bands"])


def _likely_pairs(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = likely(_matrix(b.column("rx")), _matrix(b.column("ry")), b.column("nx").to_numpy(), b.column("ny").to_numpy(), percent)
                yield pa.record_batch([b.column(c).filter(pa.array(ok)) for c in ("x", "y", "dx", "dy")], ["x", "y", "dx", "dy"])

    return run


class Members:
    """Rows (fp, n, lab, bands, regs, sketch) of groups, compared one with many."""

    def __init__(self, t: pa.Table, percent: int) -> None:
        self.percent = percent
        self.fp, self.n, self.lab, self.bands = (t.column(c).to_numpy() for c in ("fp", "n", "lab", "bands"))
        self.regs = _matrix(t.column("regs"))
        self.by_band = self.regs[:, : BANDS * ROWS].reshape(-1, ROWS, BANDS)
        self.sketches = Sketches([np.array(x, np.int64) for x in t.column("sketch").to_pylist()])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likely pairs of different components between two lists of rows; a list with itself gives each pair once."""
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left:
            at = right[right > i] if right is left else right
            at = at[self.lab[at] != self.lab[i]]
            at = at[likely(np.broadcast_to(self.regs[i], (len(at), BUCKETS)), self.regs[at], np.broadcast_to(self.n[i], len(at)), self.n[at], self.percent)]
            if not len(at):
                continue
            # Of all groups of as many bands, the pair is made in the one of its first common bands.
            same = (self.by_band[i] == self.by_band[at]).all(axis=1)
            own = (self.bands[i] >> np.arange(BANDS)) & 1 == 1
            at = at[(same & (np.cumsum(same, axis=1) <= own.sum())).sum(axis=1, where=own) == own.sum()]
            both = self.n[at] + self.n[i]
            at = at[self.sketches.apart(int(i), at) <= both - 2 * overlap(both, 0, self.percent)]
            xs.append(np.minimum(self.fp[i], self.fp[at]))
            ys.append(np.maximum(self.fp[i], self.fp[at]))
        return np.concatenate(xs), np.concatenate(ys)


_PAIR = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _within(percent: int) -> Callable:
    """Likely pairs inside the groups of sorted rows (key, fp, n, lab, regs), across the borders of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("key").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            # The last group may go on in the next batch.
            if len(begin) > 1:
                yield of(t.slice(0, begin[-1]), begin)
                t = t.slice(begin[-1])
            rest = t
        if rest is not None and len(rest):
            yield of(rest, np.array([0, len(rest)]))

    def of(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        members, found = Members(t, percent), []
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            rows = np.arange(a, b)
            found.append(members.pairs(rows, rows))
        return pa.record_batch([pa.array(np.concatenate([f[i] for f in found])) for i in range(2)], schema=_PAIR)

    return run


def _across(percent: int) -> Callable:
    """Likely pairs between two blocks of a group; a block with itself has each row once, as side 0."""

    def run(g: pa.Table) -> pa.Table:
        side = g.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, y = Members(g, percent).pairs(left, right if len(right) else left)
        return pa.Table.from_arrays([pa.array(x), pa.array(y)], schema=_PAIR)

    return run


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


class Near:
    """The links found so far between classes of equal sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> None:
        self.docs, self.reps, self.k, self.percent = docs, reps, k, percent
        self.links, self.tried, self.comp = [], [], None

    def label(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component ``lab`` of their ``fp``."""
        if self.comp is None:
            return rows.withColumn("lab", F.col("fp"))
        return rows.join(self.comp, rows["fp"] == self.comp["id"], "left").select(*rows.columns, F.coalesce("component", "fp").alias("lab"))

    def add(self, pairs: DataFrame) -> None:
        """Verify candidate pairs (x, y) that were not verified before and unite what is linked."""
        pairs = pairs.distinct()
        for before in self.tried:
            pairs = pairs.join(before, ["x", "y"], "left_anti")
        end = lambda s: self.reps.where("rep is not null").select(F.col("fp").alias(s), F.col("n").alias("n" + s), F.col("rep").alias("d" + s), F.col("regs").alias("r" + s), F.col("sketch").alias("k" + s))
        arrow_rows(self.docs.sparkSession, TEXT_ROWS)
        pairs = pairs.join(end("x"), "x").join(end("y"), "y")
        need = F.ceil(self.percent * (F.col("nx") + F.col("ny")) / (100 + self.percent) - 1e-9)
        pairs = pairs.where(apart("kx", "ky") <= F.col("nx") + F.col("ny") - 2 * need).drop("kx", "ky")
        pairs = cut(pairs.mapInArrow(_likely_pairs(self.percent), "x long, y long, dx long, dy long"))
        self.tried.append(pairs.select("x", "y"))
        self.links.append(cut(self._verified(pairs)))
        self.comp = cut(components(reduce(DataFrame.union, self.links)))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        need = small(cut(pairs.select(F.col("dx").alias("doc_id")).union(pairs.select("dy")).distinct()))
        texts = self.docs.join(need, "doc_id", "left_semi")
        # The text of a class with very many pairs goes to several tasks.
        ends = pairs.select("dx").union(pairs.select("dy")).groupBy(F.col("dx").alias("d")).count().where(F.col("count") > SALT_PAIRS)
        hot = cut(ends.select("d", F.ceil(F.col("count") / SALT_PAIRS).cast("int").alias("parts")))
        side = lambda s: self._salted(texts, hot, "doc_id").select(F.col("doc_id").alias("d" + s), F.col("text").alias("t" + s), F.col("salt").alias("s" + s))
        for s, other in (("x", "y"), ("y", "x")):
            h = small(hot).select(F.col("d").alias("d" + s), F.col("parts").alias("p" + s))
            pairs = pairs.join(h, "d" + s, "left").withColumn("s" + s, F.pmod(F.xxhash64("d" + other), F.coalesce("p" + s, F.lit(1))).cast("int")).drop("p" + s)
        arrow_rows(self.docs.sparkSession, PAIR_ROWS)
        # Always by sorted merge, so the plan is one and the same at every size.
        met = pairs.hint("merge").join(side("x"), ["dx", "sx"]).hint("merge").join(side("y"), ["dy", "sy"])
        met = met.select(F.col("x"), F.col("y"), F.col("x").alias("fx"), F.col("y").alias("fy"), "tx", "ty")
        return met.mapInArrow(_verify(self.k, self.percent), "u long, v long").distinct()

    @staticmethod
    def _salted(texts: DataFrame, hot: DataFrame, on: str) -> DataFrame:
        out = texts.join(small(hot).withColumnRenamed("d", on), on, "left")
        return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _mixed(near: Near, met: DataFrame) -> DataFrame:
    """The members, with ``lab``, of groups that hold several components."""
    met = near.label(met)
    keys = met.groupBy("key").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo <> hi").select("key")
    return cut(met.join(keys, "key", "left_semi"))


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    arrow_rows(spark, TEXT_ROWS)
    rows = written(docs.mapInArrow(_signatures(k), "doc_id long, n long, fp long, regs binary, sketch array<long>"))
    reps = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs", ignorenulls=True).alias("regs"), F.first("sketch", ignorenulls=True).alias("sketch"))
    reps = written(reps)
    near = Near(docs, reps, k, percent)
    groups = reps.select("fp", "regs", F.lit(0).cast("long").alias("bands")).mapInArrow(_groups, "key long, fp long, bands long")
    for level in range(LEVELS):
        size = groups.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        met = cut(groups.join(size, "key"))
        popular = met.groupBy("fp").agg(F.sum("m").alias("p"))
        known = near.label(met)
        lead = known.join(popular, "fp").groupBy("key").agg(F.max(F.struct("p", "fp", "lab")).alias("lead"))
        stars = known.join(lead, "key").where("fp <> lead.fp and lab <> lead.lab").select("fp", F.col("lead.fp").alias("lead"))
        near.add(stars.select(*_pairs("fp", "lead")))
        met = _mixed(near, met)
        few = met.where(F.col("m") <= LARGE).join(reps.select("fp", "n", "regs", "sketch"), "fp").select("key", "fp", "n", "lab", "bands", "regs", "sketch")
        arrow_rows(spark, TEXT_ROWS)
        near.add(few.repartition("key").sortWithinPartitions("key").mapInArrow(_within(percent), "x long, y long"))
        met = met.where(F.col("m") > LARGE)
        if not met.head(1):
            break
        met = _mixed(near, met.drop("lab"))
        if level == LEVELS - 1:
            near.add(_block_pairs(met, reps, percent))
            break
        finer = met.select("fp", "bands").distinct().join(reps.select("fp", "regs"), "fp").select("fp", "regs", "bands")
        groups = cut(finer.mapInArrow(_groups, "key long, fp long, bands long").distinct())
    if near.comp is None:
        label = reps.select("fp", F.col("fp").alias("lab"), "rep")
    else:
        label = near.label(reps.select("fp", "rep"))
    least = label.groupBy("lab").agg(F.min("rep").alias("least"))
    named = label.join(least, "lab").select("fp", "least")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _block_pairs(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of different components in groups of any size, by pairs of blocks."""
    members = members.join(reps.select("fp", "n", "regs", "sketch"), "fp")
    members = members.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    members = members.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other"), "side": (F.col("blk") > F.col("other")).cast("int")})
    return members.select("key", "i", "j", "fp", "n", "regs", "sketch", "bands", "lab", "side").groupBy("key", "i", "j").applyInArrow(_across(percent), "x long, y long")


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS m
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * m >= 85 * (nx + ny - m)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS kept
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
