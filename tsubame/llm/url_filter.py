"""URL rules by a Bloom filter cascade, exact over the corpus's complete key universe.

A key is a host suffix (at label borders) plus a path prefix; a rule is a listed key.
The universe holds every key of every URL whose prefix length some rule has. Level 1
of a cascade encodes the listed keys; level 2 the universe's false positives of level
1; level 3 the listed keys that level 2 hits by mistake; and so on, until none is
left. The first level that misses a key then tells exactly whether it is listed, for
each key of the universe, without a join against the list. One cascade holds all
block rules, one all allow rules; the longest listed key of a URL decides. A URL with
no listed key gets the cascade's answer for "not listed": allow.

Levels are arrays of 64-bit words built by distributed bit_or and broadcast as such; a
level larger than ``MAX_BITS`` is an error, so what each task holds is bounded.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is
allowed; repeated URLs are judged alike; further columns are ignored. A rule that is
listed both ways is blocked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.llm import textvec as tv
from tsubame.session import cut, table

BLOCK = ["com/en/", "example.net/de/8", "org/es/"]
ALLOW = ["example.com/en/7", "net/de/"]
MAX_BITS = 1 << 30
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """All keys of a URL, longest first: host suffixes of given label counts with path prefixes of given lengths.

    Of equal length the key with the longer host comes first.
    """
    parts = F.split(host, r"\.")
    n = F.size(parts)
    counts = F.filter(F.array(*[F.lit(x) for x in sorted(set(labels), reverse=True)]), lambda x: x <= n)
    suffixes = F.transform(counts, lambda c: F.array_join(F.slice(parts, n - c + 1, c), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in sorted(set(lengths))]), lambda x: x <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda x: F.concat(s, F.substring(path, F.lit(1), x)))))
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(keys), order))


class Level:
    """One Bloom filter: ``bits`` positions, ``hashes`` of them for each key."""

    def __init__(self, count: int, rate: float, seed: int) -> None:
        self.seed = seed
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, -(-int(count * self.hashes * 1.45 + 64) // 64) * 64)
        if self.bits > MAX_BITS:
            raise ValueError(f"a filter level needs {self.bits} bits; more than {MAX_BITS} are not held in memory")
        self.words = np.zeros(0, tv.U)

    def places(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """(hashes x keys) positions, given two hashes of each key."""
        step = np.arange(1, self.hashes + 1, dtype=tv.U)[:, None]
        return tv.mix(h + step * (g | tv.U(1)) + np.full(1, self.seed, tv.U) * tv.odd(7)) % tv.U(self.bits)

    def filled(self, keys: DataFrame) -> Level:
        """This level with the bits of these keys, gathered by bit_or over all partitions."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = self.places(*(b.column(i).to_numpy().view(tv.U) for i in (0, 1))).ravel()
                at.sort()
                word = at >> tv.U(6)
                start = np.flatnonzero(np.diff(word, prepend=~tv.U(0)))
                value = np.bitwise_or.reduceat(tv.U(1) << (at & tv.U(63)), start) if len(at) else at
                yield pa.record_batch([pa.array(word[start].astype(np.int64)), pa.array(value.view(np.int64))], ["w", "v"])

        found = keys.select(*_hashes(F.col("key"))).mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
        self.words = np.zeros(self.bits // 64, tv.U)
        self.words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(tv.U)
        return self

    def hit(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        at = self.places(h, g)
        return ((self.words[(at >> tv.U(6)).astype(np.int64)] >> (at & tv.U(63))) & tv.U(1)).all(axis=0)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


def member(levels: list[Level], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The first level that misses a key decides: an odd number of hits before it means listed."""
    out = np.full(len(h), len(levels) % 2 == 1)
    open_ = np.arange(len(h))
    for i, level in enumerate(levels):
        hit = level.hit(h[open_], g[open_])
        out[open_[~hit]] = i % 2 == 1
        open_ = open_[hit]
    return out


def _members(spark: SparkSession, levels: list[Level], keys: Column) -> Column:
    """array<boolean> for an array of keys; the levels' bits are broadcast once to each executor."""
    shared = spark.sparkContext.broadcast(levels)

    @F.arrow_udf("array<boolean>")
    def test(h: pa.Array, g: pa.Array) -> pa.Array:
        size = h.value_lengths().fill_null(0).to_numpy()
        flat = (x.flatten().to_numpy().view(tv.U) for x in (h, g))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(member(shared.value, *flat), pa.bool_()))

    return test(F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1]))


class Cascade:
    """Exact membership of ``listed`` keys for every key of ``universe`` (columns key)."""

    def __init__(self, universe: DataFrame, listed: DataFrame, seed: int = 11) -> None:
        self.levels: list[Level] = []
        self.spark = universe.sparkSession
        both = universe.select("key", F.lit(0).alias("in")).union(listed.select("key", F.lit(1)))
        both = cut(both.groupBy("key").agg(F.max("in").alias("in")))
        inside, outside = both.where("in = 1").select("key"), both.where("in = 0").select("key")
        held = inside.count()
        around = outside.count() if held else 0
        while held and len(self.levels) < MAX_LEVELS:
            rate = 0.5 if self.levels else min(0.5, max(1e-9, held * math.sqrt(0.5) / max(1, around)))
            level = Level(held, rate, seed + len(self.levels)).filled(inside)
            self.levels.append(level)
            wrong = cut(outside.where(F.get(_members(self.spark, [level], F.array("key")), 0)))
            inside, outside = wrong, inside
            held = wrong.count()
        if held:
            raise RuntimeError("the cascade did not end")

    def contains(self, keys: Column) -> Column:
        """array<boolean>, exact for keys of the universe."""
        return _members(self.spark, self.levels, keys)


def judge(pages: DataFrame, block: list[str], allow: list[str]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    spark = pages.sparkSession
    rules_ = [*block, *allow]
    if bad := [r for r in rules_ if "/" not in r]:
        raise ValueError(f"a rule needs a host and a path that begins with a slash: {bad[:3]}")
    lengths = [len(r) - r.index("/") for r in rules_]
    labels = [r[: r.index("/")].count(".") + 1 for r in rules_]
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths, labels))
    universe = cut(urls.select(F.explode("keys").alias("key")).distinct())
    rules = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    blocked, allowed = Cascade(universe, rules(block), 11), Cascade(universe, rules(sorted(set(allow) - set(block))), 1_011)
    urls = urls.withColumns({"b": blocked.contains(F.col("keys")), "a": allowed.contains(F.col("keys"))})
    marked = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("b", i).alias("b"), F.get("a", i).alias("a")))
    urls = urls.withColumn("best", F.get(F.filter(marked, lambda x: x["b"] | x["a"]), 0))
    verdict = F.when(F.col("best.b"), "block").otherwise("allow")
    return urls.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), BLOCK, ALLOW)


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
r(host, path, act) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, r.host || r.path AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.act, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
