"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts earlier
(smaller doc_id, or earlier in the same document). Matches never cross documents.

1. Identical documents are collapsed: all but the first go whole.
2. Every window of LENGTH bytes has an anchor, its leftmost smallest ``GRAM``-byte
   hash, so equal windows have equal anchors. Windows in a row with one anchor form a
   segment. Segments travel as (anchor, content hash, place), packed, to a bucket of
   their anchor; equal segments are collapsed there and all but the first go whole.
   Segments whose anchor occurs once cannot repeat and end here.
3. What is left are different segments around one anchor. Their bytes meet in buckets,
   in shards of bounded size. Each shard gets its suffix order and its transform; the
   transforms are merged by interleave refinement: each round turns the order by the
   first h symbols into that by the first h + 2, moving only source numbers by the
   preceding pair of symbols, and a border between neighbours appears in the round of
   their common prefix. After LENGTH / 2 rounds the intervals without a border are the
   repeated strings, and all but their first windows go.
   An anchor with more than ``GROUP_SEGMENTS`` different segments deals its windows out
   one by one, by their own hash, so no bucket holds a hot anchor.
4. Ranges meet their documents, and the remaining bytes are hashed.

Defined cases: a null text is empty; texts below LENGTH bytes lose nothing; rows with
one doc_id and equal texts are one document and lose the same bytes; rows with one
doc_id and different texts are documents of their own, in the order of a hash of the
text; a null doc_id comes after all others; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.llm import textvec as tv
from tsubame.session import arrow_rows, cut, shuffle_partitions, small, table, written

LENGTH = 100
GRAM = 40
GROUP_SEGMENTS = 4_096
BYTES_PER_BUCKET = 12_000_000
ENTRIES_PER_FLUSH = 1_000_000
MERGE_BYTES = 1 << 19
SHARD_BYTES = 1 << 17
TEXT_ROWS = 1_024
LAST = np.iinfo(np.int64).max

_SEGMENT = np.dtype([("h", "<u4"), ("c", "<u8"), ("d", "<i8"), ("s", "<u4"), ("n", "<u2")])
_RANGE = np.dtype([("d", "<i8"), ("a", "<u4"), ("b", "<u4")])
_ASK = np.dtype([("d", "<i8"), ("s", "<u4"), ("n", "<u2"), ("g", "<u8"), ("each", "<u1")])
_HEAD = np.dtype([("g", "<u8"), ("d", "<i8"), ("s", "<u4"), ("n", "<u2")])
_BLOBS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_BLOB_DDL = "kind int, bucket int, blob binary"


def _pack(kind: int, bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One blob of rows for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    start = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(bucket)) if len(start) else start
    blobs = [rows[i:j].tobytes() for i, j in zip(start, ends, strict=True)]
    return pa.record_batch([pa.array(np.full(len(start), kind, np.int32)), pa.array(bucket[start].astype(np.int32)), pa.array(blobs, pa.binary())], schema=_BLOBS)


def _unpack(blobs: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in blobs), kind)


def doc_bucket(d: np.ndarray, buckets: int) -> np.ndarray:
    return ((d ^ (d >> 17)) % buckets).astype(np.int32)


def _doc_bucket(buckets: int) -> Column:
    d = F.coalesce("doc_id", F.lit(int(LAST)))
    return F.pmod(d.bitwiseXOR(F.shiftright(d, 17)), F.lit(buckets)).cast("int")


def _ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def segments(data: np.ndarray, at: np.ndarray, t: tv.Tables) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, anchor hash, content hash) of all segments."""
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, tv.U, tv.U))
    n, w = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return none
    t.grow(n + 1)
    total = np.empty(n + 1, dtype=tv.U)
    total[0] = 0
    np.cumsum(t.byte[data] * t.power[:n], out=total[1:])
    gram = tv.mix((total[GRAM:] - total[:-GRAM]) * t.inverse[: n - GRAM + 1])
    size = np.diff(at)
    own = np.repeat(at[:-1], size)
    # High bits decide, then the place in the text, so equal windows choose alike.
    key = (gram & ~tv.U((1 << 31) - 1)) | (np.arange(n - GRAM + 1) - own[: n - GRAM + 1]).astype(tv.U)
    low, span = key, 1
    while span < w:
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    doc = np.repeat(np.arange(len(size)), size)[: len(low)]
    start = np.arange(len(low))
    ok = start + LENGTH <= at[1:][doc]
    start, doc, low = start[ok], doc[ok], low[ok]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    s, d = start[first], doc[first]
    anchor = gram[at[d] + (low[first] & tv.U((1 << 31) - 1)).astype(np.int64)]
    e = s + windows + LENGTH - 1
    content = tv.mix((total[e] - total[s]) * t.inverse[s] + (e - s).astype(tv.U))
    return d, s - at[d], windows, anchor, content


def _deal(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kept, held = tv.Tables(), [], 0
        for b in batches:
            ids = _ids(b.column(0))
            for i, j, data, at in tv.chunks(b.column(1)):
                d, s, n, h, c = segments(data, at, t)
                e = np.empty(len(d), _SEGMENT)
                e["h"], e["c"], e["d"], e["s"], e["n"] = h & tv.U(0xFFFFFFFF), c, ids[i:j][d], s, n
                kept.append(((h >> tv.U(32)) % tv.U(buckets), e))
                held += len(e)
                if held >= ENTRIES_PER_FLUSH:
                    yield _pack(0, *map(np.concatenate, zip(*kept, strict=True)))
                    kept, held = [], 0
        if held:
            yield _pack(0, *map(np.concatenate, zip(*kept, strict=True)))

    return run


def _collapse(buckets: int) -> Callable:
    """Of equal segments all but the first go; different ones around an anchor are asked for."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        e = _unpack(group.column("blob"), _SEGMENT)
        e = e[np.lexsort((e["s"], e["d"], e["c"], e["h"]))]
        head, new = np.ones(len(e), bool), np.ones(len(e), bool)
        head[1:] = e["h"][1:] != e["h"][:-1]
        new[1:] = head[1:] | (e["c"][1:] != e["c"][:-1])
        gone = e[~new]
        ranges = np.empty(len(gone), _RANGE)
        ranges["d"], ranges["a"], ranges["b"] = gone["d"], gone["s"], gone["s"] + gone["n"] + (LENGTH - 1)
        kinds = np.bincount((np.cumsum(head) - 1)[new])[(np.cumsum(head) - 1)[new]] if len(e) else np.zeros(0, np.int64)
        left, kinds = e[new][kinds > 1], kinds[kinds > 1]
        ask = np.empty(len(left), _ASK)
        ask["d"], ask["s"], ask["n"], ask["each"] = left["d"], left["s"], left["n"], kinds > GROUP_SEGMENTS
        ask["g"] = (np.uint64(bucket) << tv.U(32)) + left["h"].astype(tv.U)
        return pa.Table.from_batches([_pack(0, doc_bucket(ranges["d"], buckets), ranges), _pack(1, doc_bucket(ask["d"], buckets), ask)])

    return run


def _fetch(buckets: int) -> Callable:
    """Bytes of the segments asked for (kind 2), or the hash of each window (kind 3)."""

    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        out, t = [pa.Table.from_batches([], schema=_BLOBS)], tv.Tables()
        ask = _unpack(asks.column("blob"), _ASK)
        ask = ask[np.argsort(ask["d"], kind="stable")]
        seen: set[int] = set()
        for d, text in zip(_ids(texts.column("doc_id").combine_chunks()), texts.column("text"), strict=True):
            mine = ask[np.searchsorted(ask["d"], d) : np.searchsorted(ask["d"], d, "right")]
            if int(d) in seen or not len(mine):
                continue
            seen.add(int(d))
            raw = (text.as_py() or "").encode()
            some = mine[mine["each"] == 0]
            b = (some["g"] % tv.U(buckets)).astype(np.int64)
            for x in tv.distinct(b):
                heads = np.empty((b == x).sum(), _HEAD)
                for f in ("g", "d", "s", "n"):
                    heads[f] = some[b == x][f]
                body = b"".join(raw[s : s + n + LENGTH - 1] for s, n in zip(heads["s"].tolist(), heads["n"].tolist(), strict=True))
                blob = np.uint32(len(heads)).tobytes() + heads.tobytes() + body
                out.append(pa.table([[2], [int(x)], [blob]], schema=_BLOBS))
            each = mine[mine["each"] == 1]
            if len(each):
                data = np.frombuffer(raw, np.uint8)
                s = np.concatenate([np.arange(a, a + n) for a, n in zip(each["s"].tolist(), each["n"].tolist(), strict=True)])
                h = tv.span_hash(t.byte[data], s, s + LENGTH, t)
                heads = np.empty(len(s), _HEAD)
                heads["g"], heads["d"], heads["s"], heads["n"] = h, d, s, 1
                out.append(pa.Table.from_batches([_pack(3, (h % tv.U(buckets)).astype(np.int64), heads)]))
        return pa.concat_tables(out)

    return run


class Shard:
    """Suffix order (to LENGTH symbols at least) and transform of some symbols.

    Symbols are bytes plus one; 0 ends each segment. The text is read in a circle.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = (key << 9) | np.roll(symbols, -j)
        depth = 7
        while True:
            # Suffixes that agree to this depth may stand in any order.
            order = np.argsort(key)
            if depth >= LENGTH:
                break
            step = np.ones(n, np.int64)
            step[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            if rank.max() == n:
                break
            key = rank * (n + 1) + np.roll(rank, -depth)
            depth *= 2
        self.order = order
        # The transform by pairs: the two symbols before each suffix.
        self.before = (symbols[order - 2] << 9) | symbols[order - 1]


def interleave(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all shards' suffixes by their first ``depth`` symbols, two a round.

    Returns, rank by rank, the number of the suffix (shard by shard, in shard order)
    and its interval; suffixes share an interval if the first symbols are equal.
    """
    sizes = [len(s.order) for s in shards]
    n = sum(sizes)
    narrow = np.uint8 if len(shards) < 256 else np.uint16
    # z: source at each rank; suffix k of a source is the k-th occurrence of it.
    z = np.repeat(np.arange(len(shards)), sizes).astype(narrow)
    before = np.concatenate([s.before for s in shards])
    # Only the order of pairs counts: renumbered, nearly always in two bytes.
    used, before = np.unique(before, return_inverse=True)
    before = before.astype(np.uint16 if len(used) <= 65_536 else np.uint32)
    border = np.zeros(n, bool)
    border[0] = True
    ids, ranks = np.empty(n, np.int32), np.arange(n, dtype=np.int32)
    for _ in range(depth // 2):
        ids[np.argsort(z, kind="stable")] = ranks
        symbol = before[ids]
        to = np.argsort(symbol, kind="stable")
        interval = np.cumsum(border, dtype=np.int32)[to]
        symbol, z = symbol[to], z[to]
        border[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
    ids[np.argsort(z, kind="stable")] = ranks
    return ids, np.cumsum(border)


def repeated(heads: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Ranges of the windows of these segments that occur in an earlier one."""
    size = heads["n"].astype(np.int64) + LENGTH - 1
    begin = np.cumsum(size) - size
    cut_at, acc = [0], 0
    for i, x in enumerate(size.tolist()):
        if acc and acc + x > SHARD_BYTES:
            cut_at.append(i)
            acc = 0
        acc += x
    cut_at.append(len(heads))
    shards, place = [], []
    for i, j in zip(cut_at[:-1], cut_at[1:], strict=True):
        own = size[i:j] + 1
        text = np.zeros(own.sum(), np.int64)
        first = np.cumsum(own) - own
        seg = np.repeat(np.arange(j - i), own)
        inside = np.arange(len(text)) - first[seg]
        real = inside < size[i:j][seg]
        text[real] = body[begin[i] : begin[i] + size[i:j].sum()].astype(np.int64) + 1
        shard = Shard(text)
        shards.append(shard)
        window = inside < heads["n"][i:j][seg]
        place.append(np.stack([np.where(window, seg + i, -1), inside])[:, shard.order])
    ids, interval = interleave(shards, LENGTH)
    seg, inside = np.concatenate(place, axis=1)[:, ids]
    ok = seg >= 0
    seg, inside, interval = seg[ok], inside[ok], interval[ok]
    return _later(interval, heads["d"][seg], heads["s"][seg].astype(np.int64) + inside)


def _later(group: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Ranges of all windows but the first of each group, joined where they overlap."""
    order = np.lexsort((s, d, group))
    group, d, s = group[order], d[order], s[order]
    gone = np.zeros(len(group), bool)
    gone[1:] = group[1:] == group[:-1]
    d, s = d[gone], s[gone]
    order = np.lexsort((s, d))
    return joined(d[order], s[order], s[order] + LENGTH)


def joined(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximal ranges of (document, from, to) rows sorted by document and start."""
    out = np.empty(0, _RANGE)
    if len(d):
        doc = np.ones(len(d), bool)
        doc[1:] = d[1:] != d[:-1]
        base = (np.cumsum(doc) - 1) * (np.int64(1) << 33)
        reach = np.maximum.accumulate(b.astype(np.int64) + base)
        new = np.ones(len(d), bool)
        new[1:] = a[1:].astype(np.int64) + base[1:] > reach[:-1]
        start = np.flatnonzero(new)
        out = np.empty(len(start), _RANGE)
        out["d"], out["a"] = d[start], a[start]
        out["b"] = reach[np.append(start[1:], len(d)) - 1] - base[start]
    return out


def _parts(heads: np.ndarray, body: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The segments dealt by anchor into parts of about MERGE_BYTES, each merged alone."""
    size = heads["n"].astype(np.int64) + LENGTH - 1
    start = np.cumsum(size) - size
    part = tv.mix(heads["g"]) % tv.U(max(1, -(-len(body) // MERGE_BYTES)))
    order = np.argsort(part, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        n = size[mine]
        at = np.arange(n.sum()) + np.repeat(start[mine] - (np.cumsum(n) - n), n)
        yield heads[mine], body[at]


def _merge(buckets: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        heads, bodies, found = [], [], [np.empty(0, _RANGE)]
        for k, blob in zip(kind, group.column("blob"), strict=True):
            if k == 2:
                raw = blob.as_py()
                n = int(np.frombuffer(raw, np.uint32, 1)[0])
                end = 4 + n * _HEAD.itemsize
                heads.append(np.frombuffer(raw[4:end], _HEAD))
                bodies.append(np.frombuffer(raw, np.uint8, offset=end))
        if heads:
            found += [repeated(h, b) for h, b in _parts(np.concatenate(heads), np.concatenate(bodies))]
        each = np.frombuffer(b"".join(x.as_py() for k, x in zip(kind, group.column("blob"), strict=True) if k == 3), _HEAD)
        if len(each):
            found.append(_later(each["g"], each["d"], each["s"].astype(np.int64)))
        ranges = np.concatenate(found)
        return pa.Table.from_batches([_pack(0, doc_bucket(ranges["d"], buckets), ranges)])

    return run


def _docs_in(kind: np.dtype) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.record_batch([pa.array(tv.distinct(np.frombuffer(x.as_py(), kind)["d"]))], ["doc_id"])

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _remove(texts: pa.Table, ranges: pa.Table) -> pa.Table:
    r = _unpack(ranges.column("blob"), _RANGE)
    r = r[np.lexsort((r["a"], r["d"]))]
    r = joined(r["d"], r["a"], r["b"])
    rows = []
    for d, text in zip(_ids(texts.column("doc_id").combine_chunks()), texts.column("text"), strict=True):
        mine = r[np.searchsorted(r["d"], d) : np.searchsorted(r["d"], d, "right")]
        raw, at, sha, gone = (text.as_py() or "").encode(), 0, hashlib.sha256(), 0
        for a, b in zip(mine["a"].tolist(), mine["b"].tolist(), strict=True):
            sha.update(raw[at:a])
            gone += b - a
            at = b
        sha.update(raw[at:])
        rows.append((None if d == LAST else int(d), len(raw), gone, len(mine), sha.hexdigest()))
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = [F.xxhash64(F.lit(i), "text").alias(f"p{i}") for i in (1, 2)]
    seen = cut(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *prints))
    shared = seen.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not shared.head(1):
        return _removed(docs, seen)
    # Numbers in the order of (doc_id, hash) stand for the documents; repeated rows are one.
    same = ["doc_id", "n_bytes", "p1", "p2"]
    order = [F.asc_nulls_last("doc_id"), "p1", "p2", "n_bytes"]
    ids = cut(seen.groupBy(*same).agg(F.count("*").cast("int").alias("copies")).orderBy(*order).withColumn("key", F.monotonically_increasing_id()))
    marked = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *prints, "text").dropDuplicates(same)
    keyed = marked.alias("m").join(ids.alias("i"), reduce(Column.__and__, [F.col(f"m.{c}").eqNullSafe(F.col(f"i.{c}")) for c in same]))
    keyed = written(keyed.select(F.col("key").alias("doc_id"), "m.text"))
    one = _removed(keyed, ids.select(F.col("key").alias("doc_id"), "n_bytes", "p1", "p2"))
    back = one.withColumnRenamed("doc_id", "key").join(ids.select("key", "doc_id", F.explode(F.expr("sequence(1, copies)"))), "key")
    return back.select("doc_id", *one.columns[1:])


def _removed(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """The result for documents with different doc_ids; ``seen`` holds their sizes and hashes."""
    spark = docs.sparkSession
    size = F.octet_length("text").cast("long")
    first = seen.where(f"n_bytes >= {LENGTH}").groupBy("n_bytes", "p1", "p2").agg(F.min(F.coalesce("doc_id", F.lit(int(LAST)))).alias("first"))
    later = F.coalesce("doc_id", F.lit(int(LAST))) > F.col("first")
    copies = cut(seen.join(first, ["n_bytes", "p1", "p2"]).where(later).select("doc_id", "n_bytes"))
    total = seen.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), total // BYTES_PER_BUCKET + 1)
    marked = docs.withColumn("_id", F.coalesce("doc_id", F.lit(int(LAST))))

    def of(ids: DataFrame, how: str, df: DataFrame = marked) -> DataFrame:
        ids = ids.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("_id")).distinct()
        return df.join(small(ids), "_id", how)

    arrow_rows(spark, TEXT_ROWS)
    firsts = of(copies, "left_anti")
    dealt = firsts.where(f"octet_length(text) >= {LENGTH}").select("doc_id", "text").mapInArrow(_deal(buckets), _BLOB_DDL)
    found = cut(dealt.groupBy("bucket").applyInArrow(_collapse(buckets), _BLOB_DDL))
    asks = found.where("kind = 1")
    asked = cut(asks.select("blob").mapInArrow(_docs_in(_ASK), "doc_id long").distinct())
    texts = of(asked, "left_semi", firsts).select(_doc_bucket(buckets).alias("bucket"), "doc_id", "text")
    fetched = texts.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(_fetch(buckets), _BLOB_DDL)
    ranges = cut(fetched.groupBy("bucket").applyInArrow(_merge(buckets), _BLOB_DDL)).union(found.where("kind = 0"))
    hit = cut(ranges.select("blob").mapInArrow(_docs_in(_RANGE), "doc_id long").distinct())
    texts = of(hit, "left_semi", firsts).select(_doc_bucket(buckets).alias("bucket"), "doc_id", "text")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    changed = texts.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(_remove, ddl)
    nothing = F.lit(0).cast("long")
    rest = of(hit, "left_anti", firsts).select("doc_id", size.alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    whole = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return changed.unionByName(rest).unionByName(whole)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
