"""Benchmark decontamination by SimHash of item-sized windows, without Python on rows.

A window of an item's length is a leak if its weighted 5-word shingles (weight: how
often they occur) have sum(min) / sum(max) of 0.8 or more with the item's.

1. Every text's shingles meet the items' shingles. A leak shares at least 4/9 of all
   shingles of window and item (8/9 of an item's, if the text is not shorter), so
   (text, item) pairs with fewer places in common are left; every place of the others
   fixes a window.
2. Each such window gets a 64-bit SimHash. Fingerprints within ``RADIUS`` bits agree
   on one of ``RADIUS + 1`` blocks at least, so an index on (item length, block,
   value) finds all of them.
3. Candidates are verified by their exact weighted similarity.

Defined cases: words are runs without space, tab, newline, vertical tab, form feed or
carriage return, in lower case; an item of fewer than five words is one shingle; items
and texts that are null, empty or without words leak nothing; a text shorter than the
item is one window; rows equal in doc_id and text are reported once. Extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.session import cut, small, table

K = 5
RADIUS = 23


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _hashes(words: str, k: int) -> Column:
    """Hash of each run of k words, given the words' hashes."""
    run = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(words), i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, run).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """64-bit SimHash of a bag of 64-bit hashes; bit counts are kept in lanes of 16 bits, in a large bag of 32."""

    def counted(per_word: int) -> Column:
        width = 64 // per_word
        mask = F.lit(sum(1 << (width * q) for q in range(per_word)))
        zero = F.array_repeat(F.lit(0).cast("long"), width)
        step = lambda acc, h: F.transform(acc, lambda a, j: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(mask))
        return F.get(F.transform(F.array(F.aggregate(hashes, zero, step)), lambda acc: bits(acc, per_word, width)), 0)

    def bits(acc: Column, per_word: int, width: int) -> Column:
        parts = []
        for j in range(width):
            for q in range(per_word):
                count = F.shiftrightunsigned(acc[j], width * q).bitwiseAND(F.lit((1 << width) - 1))
                at = width * q + j
                parts.append(F.when(2 * count > F.size(hashes), F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return F.when(F.size(hashes) < 1 << 16, counted(4)).otherwise(counted(2))


def _blocks(fp: str) -> Column:
    """(number, value) of each of the RADIUS + 1 bit blocks of a fingerprint."""
    n, out, at = RADIUS + 1, [], 0
    for b in range(n):
        width = 64 // n + (b < 64 % n)
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        out.append(F.struct(F.lit(b).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) of the best window of each leak."""
    items = benchmark.select("item_id", F.transform(_words("text"), lambda w: F.xxhash64(w)).alias("hw"))
    items = items.select("item_id", F.size("hw").alias("len"), F.least(F.size("hw"), F.lit(k)).alias("k"), "hw").where("len > 0").distinct()
    pick = lambda hw, of: F.coalesce(*[F.when(F.col(of) == j, _hashes(hw, j)) for j in range(1, k + 1)])
    items = cut(items.withColumn("hs", pick("hw", "k")).drop("hw"))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.transform(_words("text"), lambda w: F.xxhash64(w)).alias("hw"))
    grams = small(cut(items.select("item_id", "len", "k", F.size("hs").alias("m"), F.posexplode("hs").alias("ipos", "h"))))
    parts = []
    for j in sizes:
        at = rows.select("doc_id", "key", F.size("hw").alias("n"), F.posexplode(_hashes("hw", j)).alias("pos", "h"))
        parts.append(at.join(grams.where(F.col("k") == j), "h"))
    if not parts:
        return _empty(docs, benchmark)
    hits = reduce(DataFrame.union, parts)
    length = F.least("len", "n")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("ipos"), F.col("n") - F.col("len")))
    shape = F.struct(start.alias("start"), length.alias("wl"), F.col("len"), F.col("k"))
    both = (F.col("m") + length - F.col("k") + 1).alias("both")
    near = hits.groupBy("doc_id", "key", "item_id", both).agg(F.size(F.collect_set("pos")).alias("places"), F.collect_set(shape).alias("ws"))
    near = near.where(9 * F.col("places") >= 4 * F.col("both"))
    near = cut(near.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("ws")))
    same = (F.col("r.doc_id").eqNullSafe(F.col("n.doc_id"))) & (F.col("r.key") == F.col("n.key"))
    windows = rows.alias("r").join(small(near).alias("n"), same).select("r.doc_id", "r.key", "hw", "ws").dropDuplicates(["doc_id", "key"])
    windows = windows.select("doc_id", "key", "hw", F.explode("ws").alias("w")).select("doc_id", "key", "w.*", F.expr("slice(hw, w.start + 1, w.wl)").alias("ww"))
    windows = windows.select("doc_id", "key", "start", "wl", "len", pick("ww", "k").alias("hs"))
    windows = cut(windows.withColumns({"fp": simhash("hs"), "wid": F.xxhash64("doc_id", "key", "start", "wl", "len")}))
    marked = cut(items.withColumn("ifp", simhash("hs")))
    index = marked.select("item_id", "len", "ifp", F.explode(_blocks("ifp")).alias("b")).select("item_id", "len", "ifp", "b.*")
    probes = windows.select("wid", "len", "fp", F.explode(_blocks("fp")).alias("b")).select("wid", "len", "fp", "b.*")
    found = probes.join(small(index), ["len", "block", "value"])
    found = found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("wid", "item_id").distinct()
    bag = lambda df, key, c: df.select(key, F.explode("hs").alias("h")).groupBy(key, "h").agg(F.count("*").alias(c))
    shared = found.join(small(bag(marked, "item_id", "ci")), "item_id").join(bag(windows, "wid", "cw"), ["wid", "h"])
    shared = shared.groupBy("wid", "item_id").agg(F.sum(F.least("ci", "cw")).alias("low"))
    sized = shared.join(windows.select("wid", "doc_id", "start", "wl", F.size("hs").alias("mw")).dropDuplicates(["wid"]), "wid").join(small(marked.select("item_id", F.size("hs").alias("mi")).distinct()), "item_id")
    high = F.col("mw") + F.col("mi") - F.col("low")
    kept = sized.where(10 * F.col("low") >= 8 * high).withColumn("similarity", F.col("low") / high)
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("at"), F.col("wl"))).alias("best")
    kept = kept.groupBy("doc_id", "item_id").agg(best)
    return kept.select("doc_id", "item_id", (-F.col("best.at")).cast("long").alias("start_word"), F.col("best.wl").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def _empty(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    ids = docs.select("doc_id").limit(0).crossJoin(benchmark.select("item_id").limit(0))
    return ids.withColumns({"start_word": F.lit(0).cast("long"), "n_words": F.lit(0).cast("long"), "similarity": F.lit(0.0)})


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS len, least(len(w), 5) AS k, w FROM iw WHERE len(w) > 0),
ig AS (SELECT item_id, len, k, greatest(len - k + 1, 1) AS m, p AS ipos, array_to_string(w[p + 1:p + k], ' ') AS g
  FROM (SELECT *, unnest(range(0, len - k + 1)) AS p FROM i)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT doc_id, n, k, p AS pos, array_to_string(w[p + 1:p + k], ' ') AS g
  FROM (SELECT doc_id, w, len(w) AS n, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, dg.k, len, n, m, pos, greatest(0, least(pos - ipos, n - len)) AS start, least(len, n) AS wl FROM dg JOIN ig USING (k, g)),
w AS (SELECT DISTINCT doc_id, item_id, k, m, start, wl FROM h),
wc AS (SELECT w.doc_id, w.item_id, w.start, w.wl, w.m, dg.g, count(*) AS c FROM w JOIN dg ON w.doc_id = dg.doc_id AND w.k = dg.k AND dg.pos BETWEEN w.start AND w.start + w.wl - w.k GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS c FROM ig GROUP BY ALL),
s AS (SELECT doc_id, item_id, start, any_value(wl) AS wl, any_value(m) AS mi, sum(wc.c) AS mw, sum(least(wc.c, coalesce(ic.c, 0))) AS low
  FROM wc LEFT JOIN ic USING (item_id, g) GROUP BY doc_id, item_id, start),
r AS (SELECT doc_id, item_id, start, wl, low / (mw + mi - low) AS similarity FROM s WHERE 10 * low >= 8 * (mw + mi - low))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(wl AS BIGINT) AS n_words, CAST(similarity AS DOUBLE) AS similarity
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
