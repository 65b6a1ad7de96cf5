"""Set-similarity self-join on word shingles by rare-first prefix filtering.

1. One pass gives each text its number of distinct shingles and a 64-bit fingerprint
   of that set; texts with equal sets form a class and go on as one.
2. Shingles are ordered rare first: by a bounded table of the most frequent ones, all
   others before them, ties by hash. Any order gives the same result; it only decides
   the cost. A set of n can reach the threshold only with sets that share one of its
   first n - ceil(t * n) + 1 shingles, so only these are dealt out, in packed blocks
   by shingle range.
3. Sets that meet on a shingle become a candidate pair if the length filter and the
   positional filter let them. Where more than ``PAIR_ALL`` meet, each is first paired
   with one of them only, after linking with ``PIVOTS`` members of other components,
   and after linking again with every member of another component that is left.
   Candidates then pass a bitmap filter: each set has a sketch of parities, and two sets
   differ in as many elements at least as their sketches in bits.
4. Each candidate pair is verified once on whole texts: suffix filter, then the exact
   intersection. Linked classes are united by distributed union-find.

Defined cases: a text with fewer than ``k`` words is one shingle; a null or empty text,
or one without words, has none and is linked with nothing. Rows that share a doc_id
share a component; rows without doc_id are linked by equal sets only. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.llm import textvec as tv
from tsubame.llm.graph import components
from tsubame.session import arrow_rows, cut, shuffle_partitions, small, table

K = 5
PERCENT = 80
FREQUENT = 100_000
PAIR_ALL = 8
PIVOTS = 8
ENTRIES_PER_BUCKET = 400_000
ENTRIES_PER_FLUSH = 1_000_000
BLOCK = 1_000
TEXT_ROWS = 1_024
PAIR_ROWS = 128
SUFFIX_RANGES = 16
SKETCH_BITS = (1 << 10, 1 << 17)


def overlap(nx: np.ndarray, ny: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least intersection at which 100 * intersection >= percent * union."""
    return -((-percent * (nx + ny)) // (100 + percent))


def distinct_sets(col: pa.Array, k: int, t: tv.Tables) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) for runs of texts."""
    for i, _, data, at in tv.chunks(col):
        words, first = tv.word_hashes(data, at, t)
        sh, begin = tv.shingles(words, first, k)
        b = begin.tolist()
        yield i, [tv.distinct(sh[p:q]) for p, q in zip(b[:-1], b[1:], strict=True)]


def fingerprint(s: np.ndarray) -> int:
    return int(tv.mix(np.array([np.sum(tv.mix(s + tv.U(0x1234567)), dtype=tv.U) + tv.U(len(s))], dtype=tv.U)).view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of elements by their low hash bits, packed into words.

    Two to four bits an element, a power of two, so sets of similar size have sketches
    of one size, or of twice the size: xor of its halves turns it into the smaller one.
    """
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 2 << max(0, len(s) - 1).bit_length()))
    odd = np.bincount((s & tv.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def apart(sx: str, sy: str) -> Column:
    """Least number of elements in which two sets with these sketches differ."""
    half = lambda s: F.floor(F.size(s) / 2).cast("int")
    fold = lambda s: F.zip_with(F.slice(s, F.lit(1), half(s)), F.slice(s, half(s) + 1, half(s)), lambda a, b: a.bitwiseXOR(b))
    x = F.when(F.size(sx) > F.size(sy), fold(sx)).otherwise(F.col(sx))
    y = F.when(F.size(sy) > F.size(sx), fold(sy)).otherwise(F.col(sy))
    bits = F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda t, v: t + F.coalesce(v, F.lit(0)))


class Sketches:
    """Sketches of the members of a group, compared one with many."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.size = np.array([len(r) for r in rows])
        self.level: dict[int, np.ndarray] = {}
        for n in np.unique(self.size):
            for m in (n, n // 2):
                self.level.setdefault(int(m), np.zeros((len(rows), m), np.int64))
        for i, r in enumerate(rows):
            m = len(r) // 2
            self.level[len(r)][i] = r
            self.level[m][i] = r[:m] ^ r[m:]

    def apart(self, a: int, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b), np.int64)
        low = np.minimum(self.size[b], self.size[a])
        fits = np.maximum(self.size[b], self.size[a]) <= 2 * low
        for n in np.unique(low[fits]):
            at = fits & (low == n)
            m = self.level[int(n)]
            # Unsigned: of a signed value numpy counts the bits of its magnitude.
            out[at] = np.bitwise_count((m[b[at]] ^ m[a]).view(np.uint64)).sum(axis=1)
        return out


def _stats(k: int) -> Callable:
    kinds = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("sketch", pa.list_(pa.int64()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tv.Tables()
        for batch in batches:
            ids = batch.column(0)
            for i, sets in distinct_sets(batch.column(1), k, t):
                n = np.array([len(s) for s in sets], np.int64)
                fp = np.array([fingerprint(s) for s in sets], np.int64)
                kind = pa.array(np.zeros(len(sets), np.int32))
                yield pa.record_batch([kind, ids.slice(i, len(sets)).cast(pa.int64()), pa.array(n), pa.array(fp), pa.array([sketch(s) for s in sets], kinds[4][1])], schema=schema)
                seen, count = np.unique(np.concatenate(sets), return_counts=True)
                often = count >= 3
                if often.any():
                    m = int(often.sum())
                    yield pa.record_batch([pa.array(np.ones(m, np.int32)), pa.array(seen[often].view(np.int64)), pa.array(count[often].astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, kinds[4][1])], schema=schema)

    return run


_ENTRY = np.dtype([("s", "<u4"), ("f", "<i8"), ("n", "<u4"), ("p", "<u2")])


def rare_first(s: np.ndarray, hot: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The sorted set ``s`` in the global order: what is not in ``hot``, then by df."""
    if not len(hot) or not len(s):
        return s
    j = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    known = hot[j] == s
    if not known.any():
        return s
    late = s[known]
    return np.concatenate([s[~known], late[np.argsort(df[j[known]], kind="stable")]])


def _entries(k: int, percent: int, buckets: int, hot: np.ndarray, df: np.ndarray) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def flush(kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        s = np.concatenate([x[0] for x in kept])
        e = np.concatenate([x[1] for x in kept])
        b = ((s >> tv.U(32)) % tv.U(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        b, e = b[order], e[order]
        edges = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(edges[1:], len(b))
        return pa.record_batch([pa.array(b[edges]), pa.array([e[i:j].tobytes() for i, j in zip(edges, ends, strict=True)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen, kept, held = tv.Tables(), set(), [], 0
        for batch in batches:
            for _, sets in distinct_sets(batch.column(0), k, t):
                for s in sets:
                    if not len(s) or (fp := fingerprint(s)) in seen:
                        continue
                    if len(seen) > ENTRIES_PER_FLUSH:
                        seen.clear()
                    seen.add(fp)
                    n = len(s)
                    head = rare_first(s, hot, df)[: n + (-percent * n) // 100 + 1]
                    e = np.empty(len(head), _ENTRY)
                    e["s"], e["f"], e["n"] = head & tv.U(0xFFFFFFFF), fp, n
                    e["p"] = np.minimum(np.arange(len(head)), 65_535)
                    kept.append((head, e))
                    held += len(head)
                if held >= ENTRIES_PER_FLUSH:
                    yield flush(kept)
                    kept, held = [], 0
        if kept:
            yield flush(kept)

    return run


def _may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filter on two aligned entry arrays."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    reach = 1 + np.minimum(na - a["p"] - 1, nb - b["p"] - 1)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (reach >= overlap(na, nb, percent))


_MET = pa.schema([("run", pa.int64()), ("fx", pa.int64()), ("nx", pa.int64()), ("px", pa.int32()), ("fy", pa.int64()), ("ny", pa.int64())])


def _meet(percent: int, stored: np.dtype = _ENTRY) -> Callable:
    """Candidate pairs and large groups of a bucket; ``stored`` may lack size and place."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        raw = np.frombuffer(b"".join(group.column("blob").to_pylist()), stored)
        e = np.zeros(len(raw), _ENTRY)
        e["n"] = 1
        for name in stored.names:
            e[name] = raw[name]
        order = np.lexsort((e["f"], e["s"]))
        e = e[order]
        new = np.ones(len(e), bool)
        new[1:] = (e["s"][1:] != e["s"][:-1]) | (e["f"][1:] != e["f"][:-1])
        e = e[new]
        head = np.ones(len(e), bool)
        head[1:] = e["s"][1:] != e["s"][:-1]
        no = np.cumsum(head) - 1
        size = np.bincount(no)
        e, no = e[size[no] > 1], no[size[no] > 1]
        out = []
        few = size[no] <= PAIR_ALL
        small, run_no = e[few], no[few]
        for d in range(1, PAIR_ALL):
            if len(small) <= d:
                break
            i = np.flatnonzero(run_no[d:] == run_no[:-d])
            if not len(i):
                break
            a, b = small[i], small[i + d]
            ok = _may_link(a, b, percent)
            out.append(np.stack([a["f"][ok], b["f"][ok], a["n"][ok].astype(np.int64), b["n"][ok].astype(np.int64)]))
        many, run_no = e[~few], no[~few]
        if len(many):
            start = np.ones(len(many), bool)
            start[1:] = run_no[1:] != run_no[:-1]
            lead = many[np.flatnonzero(start)[np.cumsum(start) - 1]]
            ok = _may_link(lead, many, percent) & ~start
            out.append(np.stack([lead["f"][ok], many["f"][ok], lead["n"][ok].astype(np.int64), many["n"][ok].astype(np.int64)]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((4, 0), np.int64)
        m, late = pairs.shape[1], len(many)
        run_id = (np.int64(bucket) << 32) + many["s"].astype(np.int64)
        void = lambda kind, n: pa.nulls(n, kind)
        cols = [
            pa.concat_arrays([void(pa.int64(), m), pa.array(run_id)]),
            pa.array(np.concatenate([pairs[0], many["f"]])),
            pa.array(np.concatenate([pairs[2], many["n"].astype(np.int64)])),
            pa.array(np.concatenate([np.zeros(m, np.int32), many["p"].astype(np.int32)])),
            pa.concat_arrays([pa.array(pairs[1]), void(pa.int64(), late)]),
            pa.concat_arrays([pa.array(pairs[3]), void(pa.int64(), late)]),
        ]
        return pa.Table.from_arrays(cols, schema=_MET)

    return run


def _across(percent: int) -> Callable:
    """Pairs of one block pair of a large group whose components differ."""
    schema = pa.schema([("fx", pa.int64()), ("fy", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        g = {c: group.column(c).to_numpy() for c in ("fx", "nx", "px", "lab", "i", "j", "blk")}
        bits = None
        if "sketch" in group.column_names:
            bits = Sketches([np.array(x, np.int64) for x in group.column("sketch").to_pylist()])
        e = np.empty(len(g["fx"]), _ENTRY)
        e["s"], e["f"], e["n"], e["p"] = 0, g["fx"], g["nx"], g["px"]
        left, right = np.flatnonzero(g["blk"] == g["i"]), np.flatnonzero(g["blk"] == g["j"])
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in left:
            b = right[(g["lab"][right] != g["lab"][a]) & ((g["fx"][right] > g["fx"][a]) | (g["i"][0] != g["j"][0]))]
            b = b[_may_link(np.broadcast_to(e[a], len(b)), e[b], percent)]
            if bits is not None and len(b):
                n = g["nx"][a] + g["nx"][b]
                b = b[bits.apart(int(a), b) <= n - 2 * overlap(n, 0, percent)]
            xs.append(np.full(len(b), e["f"][a], np.int64))
            ys.append(e["f"][b].astype(np.int64))
        return pa.Table.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], schema=schema)

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on two sorted sets, after the suffix filter on hash ranges."""
    nx, ny = len(x), len(y)
    if not nx or not ny:
        return False
    need = int(overlap(np.int64(nx), np.int64(ny), percent))
    if min(nx, ny) < need:
        return False
    cuts = np.arange(1, SUFFIX_RANGES, dtype=tv.U) << tv.U(60)
    cx = np.diff(np.searchsorted(x, cuts), prepend=0, append=nx)
    cy = np.diff(np.searchsorted(y, cuts), prepend=0, append=ny)
    if np.abs(cx - cy).sum() > nx + ny - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _verify(k: int, percent: int) -> Callable:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tv.Tables()
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            x, y = ([s for _, run_ in distinct_sets(col[c], k, t) for s in run_] for c in ("tx", "ty"))
            fx, fy = col["fx"].to_pylist(), col["fy"].to_pylist()
            ok = [fingerprint(p) == fx[i] and fingerprint(q) == fy[i] and similar(p, q, percent) for i, (p, q) in enumerate(zip(x, y, strict=True))]
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([col["x"].filter(keep), col["y"].filter(keep)], schema=schema)

    return run


def _linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified (u, v) of candidate fingerprint pairs, as representative doc_ids."""
    spark = docs.sparkSession
    ends = lambda s: reps.select(F.col("fp").alias("f" + s), F.col("rep").alias(s), F.col("n").alias("n" + s), F.col("sketch").alias("s" + s))
    pairs = pairs.select("fx", "fy").distinct().join(ends("x"), "fx").join(ends("y"), "fy").where("x is not null and y is not null")
    need = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent) - 1e-9)
    pairs = cut(pairs.where(apart("sx", "sy") <= F.col("nx") + F.col("ny") - 2 * need).select("x", "y", "fx", "fy"))
    need = small(cut(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()))
    texts = docs.select("doc_id", "text").join(need, "doc_id", "left_semi")
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias("t" + s))
    arrow_rows(spark, PAIR_ROWS)
    # Always by sorted merge, so the plan is one and the same at every size.
    met = pairs.hint("merge").join(side("x"), "x").hint("merge").join(side("y"), "y")
    return met.select("x", "y", "fx", "fy", "tx", "ty").mapInArrow(_verify(k, percent), "u long, v long")


def _labels(reps: DataFrame, comp: DataFrame) -> DataFrame:
    """(fp, lab): the component of each class so far."""
    return reps.join(comp, reps["rep"] == comp["id"], "left").select("fp", F.coalesce("component", "rep").alias("lab"))


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member with a few members of its group, the same for all, of other components."""
    picks = [F.min(F.struct(F.xxhash64(F.lit(i), "fx"), F.col("fx"), F.col("nx"), F.col("lab"))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = members.groupBy("run").agg(*picks).select("run", F.array(*[f"p{i}" for i in range(PIVOTS)]).alias("ps"))
    met = members.join(pivots, "run").select("fx", "nx", "lab", F.explode("ps").alias("p")).where("lab <> p.lab")
    close = 100 * F.least("nx", "p.nx") >= percent * F.greatest("nx", "p.nx")
    return met.where(close).select(F.least("fx", "p.fx").alias("fx"), F.greatest("fx", "p.fx").alias("fy"))


def _cross_pairs(members: DataFrame, percent: int, across: Callable = _across) -> DataFrame:
    """All pairs of a group whose components differ, in blocks of bounded size."""
    left = members.withColumn("nb", F.ceil(F.col("m") / BLOCK)).withColumn("blk", F.pmod(F.xxhash64("fx"), F.col("nb")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    left = left.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")}).select("run", "i", "j", "blk", "fx", "nx", "px", "lab", *[c for c in members.columns if c == "sketch"])
    return left.groupBy("run", "i", "j").applyInArrow(across(percent), "fx long, fy long")


def join_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    arrow_rows(spark, TEXT_ROWS)
    seen = cut(docs.mapInArrow(_stats(k), "kind int, a long, b long, c long, sketch array<long>"))
    rows = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("fp"), "sketch")
    reps = rows.where("n_shingles > 0").groupBy("fp", F.col("n_shingles").alias("n"))
    reps = cut(reps.agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    often = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("df")).where("df >= 10").orderBy(F.desc("df"), "a").limit(FREQUENT).collect()
    hot = np.array([r["a"] for r in often], np.int64).view(tv.U)
    by = np.argsort(hot)
    hot, df = hot[by], np.array([r["df"] for r in often], np.int64)[by]
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), total * (100 - percent) // 100 // ENTRIES_PER_BUCKET + 1)
    dealt = docs.select("text").mapInArrow(_entries(k, percent, buckets, hot, df), "bucket int, blob binary")
    met = cut(dealt.groupBy("bucket").applyInArrow(_meet(percent), "run long, fx long, nx long, px int, fy long, ny long"))
    links = cut(_linked(docs, reps, met.where("run is null"), k, percent))
    comp = cut(components(links))
    late = cut(met.where("run is not null").select("run", "fx", "nx", "px"))
    for pair_up in (_pivot_pairs, _cross_pairs) if late.head(1) else ():
        label = _labels(reps, comp)
        labelled = late.join(label, F.col("fx") == F.col("fp")).select("run", "fx", "nx", "px", "lab")
        mixed = labelled.groupBy("run").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
        mixed = cut(mixed.select("run", "m"))
        if not mixed.head(1):
            break
        members = labelled.join(mixed, "run")
        if pair_up is _cross_pairs:
            members = members.join(reps.select(F.col("fp").alias("fx"), "sketch"), "fx")
        more = pair_up(members, percent)
        links = cut(links.union(_linked(docs, reps, more, k, percent)))
        comp = cut(components(links))
    label = _labels(reps, comp)
    out = rows.join(label, "fp", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("lab"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS m
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * m >= 80 * (nx + ny - m)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
