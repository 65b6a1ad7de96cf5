"""Spelling variants by anagram hashing: integer keys that ignore the order of letters.

A word's key is the sum of a power of each letter's code point, so inserting, deleting or
exchanging one letter shifts the key by that letter's value, or by the difference of two.
Words whose keys differ by such a value meet in one equality join: each word brings
its key less the value of each of its letters (removal), and its own key (nothing
removed). Removal against nothing removed is an addition or removal, removal against
removal an exchange. What meets is verified by the order of letters.

Keys on which more than ``GROUP`` entries meet, many words of the same letters, are split
by that order first: an entry there carries the hash of the word without the letter, once
for each place of the letter, and meets only entries of equal hash and place. Both ways
find the same pairs; no group is paired with itself beyond ``GROUP`` entries of a key.

Words are counted inside the tasks before the shuffle. Forms are followed to their roots
by doubling steps, as many as the binary logarithm of the longest chain, which is
itself at most logarithmic, since counts at least double at every step.

Defined cases: a null or empty text has no words; in a row without doc_id no run loses
a code point; rows that repeat a doc_id count each on their own; words of any length are
whole; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.session import arrow_rows, cut, small, table, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
POWER = 5
GROUP = 64
WORDS_PER_FLUSH = 500_000
TEXT_ROWS = 1_024

_FOLD = {c: c + 32 for c in range(65, 91)}


def spelled(run: str, prefix: int | None) -> str:
    """The word of a lower-cased run, given the crc32 of ``<doc_id>:``."""
    if prefix is None or (h := zlib.crc32(run.encode(), prefix)) % DROP:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _counts(least: int) -> Callable:
    """(word, n) of the words of at least ``least`` code points, counted inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = None if doc is None else zlib.crc32(f"{doc}:".encode())
                own: dict[str, int] = {}
                for x in RUN.findall(text.translate(_FOLD) if text else ""):
                    own[x] = own.get(x, 0) + 1
                for x, n in own.items():
                    # A run of ``least`` code points may lose one.
                    if len(x) >= least and len(w := spelled(x, prefix)) >= least:
                        total[w] = total.get(w, 0) + n
                if len(total) >= WORDS_PER_FLUSH:
                    yield flush()
        if total:
            yield flush()

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    arrow_rows(docs.sparkSession, TEXT_ROWS)
    found = docs.select("doc_id", "text").mapInArrow(_counts(least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _value(letter: Column) -> Column:
    x = F.ascii(letter).cast("long")
    return x * x * x * x * x


def _entries(words: DataFrame) -> DataFrame:
    """(key, word, n, gone): each word's key, whole (no ``gone``) and less each of its letters."""
    letters = F.split("word", "")
    with_key = words.select("word", "n", F.aggregate(letters, F.lit(0).cast("long"), lambda t, c: t + _value(c)).alias("whole"), F.array_distinct(letters).alias("letters"))
    gone = with_key.select("word", "n", "whole", F.explode(F.concat(F.array(F.lit("")), "letters")).alias("gone"))
    return gone.select((F.col("whole") - F.when(F.col("gone") == "", F.lit(0).cast("long")).otherwise(_value(F.col("gone")))).alias("key"), "word", "n", "gone")


def _sides(entries: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of entries, each pair once, that may differ in one letter."""
    a = entries.select(*on, F.col("word").alias("a"), F.col("n").alias("na"), F.col("gone").alias("ga"))
    b = entries.select(*on, F.col("word").alias("b"), F.col("n").alias("nb"), F.col("gone").alias("gb"))
    # Exchange: two different letters are gone; addition: the letter is gone from the second word only.
    met = a.join(b, on).where("ga <> gb and gb <> '' and (ga = '' or a < b)")
    return met.select("a", "na", "b", "nb")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words that differ by one code point, once."""
    entries = _entries(words)
    hot = cut(entries.groupBy("key").count().where(F.col("count") > GROUP).select("key"))
    hot_ = small(hot)
    few = _sides(entries.join(hot_, "key", "left_anti"), ["key"])
    many = entries.join(hot_, "key", "left_semi")
    # By order: the word without the letter, at each of its places.
    places = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.col("word").substr(i, F.lit(1)) == F.col("gone"))
    many = many.withColumn("place", F.explode(F.when(F.col("gone") == "", F.array(F.lit(0))).otherwise(places)))
    rest = F.concat(F.col("word").substr(F.lit(1), F.col("place") - 1), F.expr("substring(word, place + 1)"))
    many = many.select("key", "word", "n", "gone", "place", F.xxhash64(F.when(F.col("place") == 0, F.col("word")).otherwise(rest)).alias("rest"))
    # An exchange needs equal places; an addition meets the whole word at any place.
    exchanged = _sides(many.where("place > 0"), ["key", "rest", "place"])
    whole, less = many.where("place = 0"), many.where("place > 0").select("key", "rest", F.col("word").alias("b"), F.col("n").alias("nb"))
    added = whole.select("key", "rest", F.col("word").alias("a"), F.col("n").alias("na")).join(less, ["key", "rest"]).select("a", "na", "b", "nb").distinct()
    one = lambda met: met.where(F.levenshtein("a", "b", 1) == 1)
    return one(few.unionByName(exchanged).unionByName(added))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms, by pointer doubling; ``forms`` has (word, form)."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").head(1):
            return at


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = written(word_counts(docs))
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")).alias("near"))
    both = both.union(pairs.select("b", "nb", F.struct((-F.col("na")).alias("less"), F.col("a").alias("form"))))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    far = -F.col("best.less") >= 2 * F.col("n")
    best = written(best.select("word", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")))
    root = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# crc32 byte by byte; the table of its 256 remainders comes from the polynomial.
ORACLE = r"""
WITH RECURSIVE bit AS (SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
own AS (SELECT doc_id, r, count(*) AS n, list_transform(string_split(coalesce(doc_id || ':', '') || r, ''), lambda c: unicode(c)) AS p FROM runs GROUP BY doc_id, r HAVING length(r) >= 5),
bytes AS (SELECT doc_id, r, n, flatten(list_transform(p, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + u % 64] END)) AS b FROM own),
hashed AS (SELECT doc_id, r, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[1 + xor(a % 256, x)])), 4294967295) AS h FROM bytes, crc),
spelled AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN holes b ON a.word = b.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN holes b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN forms f ON w.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
