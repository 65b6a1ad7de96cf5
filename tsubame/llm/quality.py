"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

A text's words are read twice: as folded spellings and as forms (byte class of the
first, second, last and last but one character, length, whether the word repeats the
one before). Features are the n-grams of both readings, hashed to ``2 ** BITS``
weights; the value of a feature is its share of the text's words. Training runs in one
task over at most ``TRAIN_ROWS`` labelled rows (those of smallest hash, a documented
bound; of documents that repeat a doc_id all count, within the same bound); scoring is a sparse dot product for each text, over whole texts.

Defined cases: a null or empty text, or one without words, has the intercept alone as
its score; without usable labels every score is 0.5; label rows with null quality and
labels without a document are ignored, repeated ones count again; extra columns are
kept and never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.llm import textvec as tv
from tsubame.session import arrow_rows, table

BITS = 18
TRAIN_ROWS = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
VALUE = 8.0
TEXT_ROWS = 1_024


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, non-ASCII; other ASCII bytes stay themselves."""
    c = np.arange(256, dtype=np.uint64) + np.uint64(16)
    c[97:123], c[65:91], c[48:58], c[128:] = 1, 2, 3, 4
    return c


def features(data: np.ndarray, at: np.ndarray, t: tv.Tables) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram family, a feature number at each word; and each text's first word."""
    starts, ends, first = tv.word_bounds(data, at, t)
    n = len(starts)
    if not n:
        return [], first
    word = tv.span_hash(t.folded[data], starts, ends, t)
    cls, length = _classes(), ends - starts
    pick = lambda i: cls[data[np.clip(i, starts, ends - 1)]]
    same = np.zeros(n, dtype=tv.U)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < n]] = 0
    form = pick(starts)
    for x in (pick(starts + 1), pick(ends - 2), pick(ends - 1), np.minimum(length, 24).astype(tv.U) >> tv.U(2), same):
        form = form * tv.U(293) + x
    form = tv.mix(form)
    ends_alike = tv.mix(pick(ends - 1) * tv.U(293) + pick(ends - 2) + tv.U(7))

    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))

    def gram(x: np.ndarray, k: int, family: int) -> np.ndarray:
        out = x * tv.odd(0) + tv.U(family)
        for j in range(1, k):
            # An n-gram does not reach into the text before.
            out[j:] += np.where(place[j:] >= j, x[:-j] * tv.odd(j), tv.U(0))
        return (tv.mix(out) >> tv.U(64 - BITS)).astype(np.int64)

    families = [(word, 1), (word, 2), (form, 1), (form, 2), (ends_alike, 1), (ends_alike, 2), (same, 3)]
    return [gram(x, k, i + 1) for i, (x, k) in enumerate(families)], first


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = tv.Tables()
    for b in batches:
        for i, j, data, at in tv.chunks(b.column(0)):
            grams, first = features(data, at, t)
            idx, val = [], []
            for p, q in zip(first[:-1], first[1:], strict=True):
                u, c = np.unique(np.concatenate([g[p:q] for g in grams]) if grams else np.zeros(0, np.int64), return_counts=True)
                idx.append(u)
                val.append(c * (VALUE / max(1, q - p)))
            yield pa.record_batch([pa.array(idx, pa.list_(pa.int64())), pa.array(val, pa.list_(pa.float64())), b.column(1).slice(i, j - i).cast(pa.int32()), b.column(2).slice(i, j - i)], ["idx", "val", "y", "o"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over (features, values, label) rows."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for e in range(epochs):
        for r in np.random.default_rng(e).permutation(len(rows)):
            i, x, y = rows[r]
            i, x = np.append(i, size - 1), np.append(x, 1.0)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        for i, v, y, o in zip(b.column(0), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            rows.append((o, i.values.to_numpy(), v.values.to_numpy(), y))
    rows.sort(key=lambda r: (r[0], r[3]))
    weights = ftrl([r[1:] for r in rows]) if rows else np.zeros((1 << BITS) + 1)
    yield pa.record_batch([pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["w"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from the labelled documents that are not held out."""
    order = F.xxhash64(F.lit(5), "doc_id")
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    few = usable.select("doc_id", F.col("quality").cast("int").alias("y"), order.alias("o")).orderBy("o", "y").limit(rows)
    arrow_rows(docs.sparkSession, TEXT_ROWS)
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y", "o")  # ``rows`` rows of 24 bytes
    vectors = known.mapInArrow(_vectors, "idx array<long>, val array<double>, y int, o long")
    # Features are made where the texts lie; only the bounded sparse rows go to the one task that trains.
    blob = vectors.orderBy("o", "y").limit(rows).repartition(1).mapInArrow(_train, "w binary").first()[0]
    return np.frombuffer(bytes(blob), "<f4")


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    t, out = tv.Tables(), np.full(len(texts), float(weights[-1]))
    for i, j, data, at in tv.chunks(texts):
        grams, first = features(data, at, t)
        if not grams:
            continue
        total = np.zeros(len(grams[0]) + 1)
        np.cumsum(sum(weights[g].astype(np.float64) for g in grams), out=total[1:])
        n = np.diff(first)
        out[i:j] += np.where(n > 0, (total[first[1:]] - total[first[:-1]]) * VALUE / np.maximum(n, 1), 0.0)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _scorer(weights: np.ndarray) -> Callable:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, weights))

    return score


def score(weights: np.ndarray, spark: SparkSession) -> Column:
    """Probability of label 1 of the column ``text``."""
    arrow_rows(spark, TEXT_ROWS)
    return _scorer(weights)("text")


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``quality_score``; 1 is best."""
    return docs.withColumn("quality_score", score(weights, docs.sparkSession))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    p = F.col("quality_score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))
