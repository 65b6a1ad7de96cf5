"""Fuzzy line dedup: MinHash of character shingles, banding, exact check, union-find.

A line's form is its text in lower case with runs of white space as one space, without
those at the ends. Equal forms are one; different forms link when their sets of
``K``-character shingles have a Jaccard similarity of 0.8 or more. Of each component
only the first line (smallest doc_id, then line number) stays in its document.

``BANDS`` bands of ``ROWS`` minima find a pair of similarity 0.8 with a probability of
0.998, and more similar ones almost surely, repetitive lines included; each candidate pair is then verified on
the exact sets. Bands travel packed, by key range; where very many lines meet in a
band they are first paired with one of them, then with a few, and then across
components only. Texts of candidates are read again at their first places.

Defined cases: blank lines are never removed; a form shorter than ``K`` is one
shingle; a null text counts as empty; lines of rows that share a doc_id and number
stay or go together; rows without doc_id are kept as they are; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.llm import textvec as tv
from tsubame.llm.graph import components
from tsubame.llm.ngram_join import Sketches, _cross_pairs, _meet, _pivot_pairs, overlap, sketch
from tsubame.session import arrow_rows, cut, shuffle_partitions, table

K = 8
BANDS, ROWS = 16, 5
# Sets of LONG shingles have a binned signature, those below SHORT a permuted one: similar ones share a kind.
LONG, SHORT = 160, 200
# Slots in which the different shingles of a line are counted; what shares a slot counts once.
SLOT_BITS = 12
PERCENT = 80
ENTRIES_PER_BUCKET = 500_000
ENTRIES_PER_FLUSH = 2_000_000
CHUNK_CHARS = 1 << 17
SEEN_LINES = 500_000
TEXT_ROWS = 1_024
PAIR_ROWS = 1_024
# Shingles of candidate pairs that are compared at a time.
PAIR_CELLS = 1 << 16

_BAND = np.dtype([("s", "<u4"), ("f", "<i8")])


# White space that, like two spaces in a row, a form cannot hold.
_OTHER_SPACE = ["  ", *(chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n")]

_ASCII_SPACE = [x for x in _OTHER_SPACE if x.isascii()]


def forms(text: str | None) -> list[str]:
    """The form of each line; blank lines give an empty one."""
    lines = (text or "").lower().split("\n")
    if text and any(x in text for x in (_ASCII_SPACE if text.isascii() else _OTHER_SPACE)):
        return [" ".join(x.split()) for x in lines]
    return [x.strip() for x in lines]


def _ends(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with K - 1 more symbols behind each: shingles a line, first places, places that begin none, all places.

    Those are in a line's end and in the symbols added.
    """
    n, whole = np.maximum(size - K + 1, 1), size + K - 1
    start = np.cumsum(whole) - whole
    over = (start + n)[:, None] + np.arange(2 * (K - 1))
    return n, start, over[over < (start + whole)[:, None]], int(whole.sum())


def line_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all K-character shingles of non-empty lines, and each line's first."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    # K - 1 symbols of no value behind each line: no shingle reaches into the next one.
    gap = "\0" * (K - 1)
    codes = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, start, over, places = _ends(size)
    v = tv.mix(codes.astype(tv.U) + tv.U(1))
    v[((start + size)[:, None] + np.arange(K - 1)).ravel()] = 0
    last = places - K + 1
    total, part = v[:last] * tv.odd(0), np.empty(last, tv.U)
    for j in range(1, K):
        total += np.multiply(v[j : last + j], tv.odd(j), out=part)
    inside = np.ones(places, bool)
    inside[over] = False
    return tv.mix(total[inside[:last]]), np.concatenate([[0], np.cumsum(n)])


def line_ids(lines: list[str]) -> np.ndarray:
    """64-bit hash of each form."""
    one = xxhash.xxh3_64_intdigest
    try:
        # Of a string, its UTF-8 is hashed, where it stands if it is ASCII.
        ids = np.fromiter(map(one, lines), tv.U, len(lines))
    except UnicodeEncodeError:
        ids = np.array([one(x.encode("utf-8", "surrogatepass")) for x in lines], tv.U)
    return ids.view(np.int64)


def _shingle_words(lines: list[str]) -> np.ndarray:
    """32-bit hashes at all places of the lines with K - 1 zeros behind each."""
    gap = "\0" * (K - 1)
    x = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    # Pairs of neighbours, then pairs of pairs, and so on up to K symbols (a power of two).
    step, i = 1, 0
    while step < K:
        y = x[step:] * _MULTIPLIERS[i + 1]
        y += x[:-step] * _MULTIPLIERS[i]
        x, step, i = y, 2 * step, i + 2
    x = np.append(x, np.zeros(K - 1, np.uint32))
    for shift, m in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(m)
    x ^= x >> np.uint32(16)
    return x


_MULTIPLIERS = [np.uint32(int(tv.odd(900 + i)) >> 32 | 1) for i in range(6)]
# Where a bin without a shingle borrows its minimum: the t-th other bin tried.
_BORROW = np.stack([np.random.default_rng(t).permutation(BANDS * ROWS) for t in range(64)])
_VOID = np.uint32(0xFFFFFFFF)


def _minima(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS permutations, for short lines: one row each, lines in columns."""
    out, mixed = np.empty((BANDS * ROWS, len(begin)), np.uint32), np.empty_like(x)
    for i in range(BANDS * ROWS):
        np.multiply(x, np.uint32(int(tv.odd(1_000 + i)) >> 32 | 1), out=mixed)
        np.minimum.reduceat(mixed, begin, out=out[i])
    return out


def _binned_minima(x: np.ndarray, whole: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Minima of the bins of one permutation, empty bins filled from others, for long lines; lines in columns.

    ``whole`` has each line's places, of which those in ``over`` begin no shingle.
    """
    bins, rows = BANDS * ROWS, len(whole)
    at = x >> np.uint32(16)
    at *= np.uint32(bins)
    at >>= np.uint32(16)
    at = at + np.repeat(np.arange(rows) * bins, whole)
    at[over] = rows * bins
    out = np.full((rows + 1) * bins, _VOID, np.uint32)
    np.minimum.at(out, at, x * np.uint32(0x9E3779B1))
    out = out.reshape(-1, bins)[:rows]
    i, j = np.nonzero(out == _VOID)
    full = out.copy()
    for t in range(len(_BORROW)):
        if not len(i):
            break
        lent = full[i, _BORROW[t][j]]
        out[i, j] = lent
        i, j = i[lent == _VOID], j[lent == _VOID]
    return out.T


def _few(x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of these lines may hold less than SHORT different values; those that do are among them.

    The first places are enough to count SHORT values; only lines that repeat themselves
    need more, and count as few.
    """
    size = np.minimum(size, 2 * SHORT)
    at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    slot = np.zeros(len(size) << SLOT_BITS, np.uint8)
    slot[(x[at] >> np.uint32(32 - SLOT_BITS)) + np.repeat(np.arange(len(size)) << SLOT_BITS, size)] = 1
    # Eight counters in a word, none of which overflows within 128 words; each then has bytes of its own.
    lanes = slot.view(np.uint64).reshape(-1, 128).sum(axis=1).view(np.uint8)
    return lanes.reshape(len(size), -1).sum(axis=1, dtype=np.int64) < SHORT


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, BANDS keys) of each signature.

    Small sets of shingles have minima of many permutations, large ones bins of one. A line
    has every kind that its set may need: binned from LONG places on, as it cannot have more
    different shingles than places, and permuted where less than SHORT different ones were
    counted, as what is counted is at most what is there. So of two sets of similarity
    0.8, whose sizes differ by a quarter at most, both have one kind.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    # By size, so that the lines of a kind stand side by side.
    order = np.argsort(size, kind="stable")
    size = size[order]
    x = _shingle_words([lines[i] for i in order.tolist()])
    n, begin, over, places = _ends(size)
    kinds = []
    a, b = np.searchsorted(n, [LONG, SHORT])
    if a < len(lines):
        at = begin[a]
        kinds.append((np.arange(a, len(lines)), 1_000, _binned_minima(x[at:], size[a:] + K - 1, over[np.searchsorted(over, at) :] - at)))
    if b:
        inside = np.ones(begin[b] if b < len(lines) else places, bool)
        inside[over[: np.searchsorted(over, len(inside))]] = False
        kinds.append((np.arange(b), 1, _minima(x[: len(inside)][inside], np.cumsum(n[:b]) - n[:b])))
    few = b + np.flatnonzero(_few(x, begin[b:], n[b:])) if b < len(lines) else np.zeros(0, np.int64)
    if len(few):
        sets = [tv.distinct(x[begin[i] : begin[i] + n[i]]) for i in few.tolist()]
        count = np.array([len(s) for s in sets])
        kinds.append((few, 1, _minima(np.concatenate(sets), np.cumsum(count) - count)))
    numbers, keys = [], []
    for number, seed, low in kinds:
        key = np.repeat((np.arange(BANDS) + seed).astype(tv.U)[:, None], len(number), axis=1)
        for r in range(ROWS):
            key = tv.mix(key * tv.odd(3) + low[r::ROWS])
        numbers.append(order[number])
        keys.append(key.T)
    return np.concatenate(numbers), np.concatenate(keys)


def _chunks(lines: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in lines:
        part.append(x)
        size += len(x)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, doc_id, line number) of every line that is not blank."""
    for b in batches:
        own = [forms(text) for text in b.column(1).to_pylist()]
        count = np.fromiter(map(len, own), np.int64, len(own))
        all_ = [x for lines in own for x in lines]
        full = np.fromiter(map(bool, all_), bool, len(all_))
        no = np.arange(len(all_)) - np.repeat(np.cumsum(count) - count, count)
        doc = np.repeat(b.column(0).cast(pa.int64()).to_numpy(), count)
        if full.any():
            yield pa.record_batch([pa.array(line_ids([x for x in all_ if x])), pa.array(doc[full]), pa.array(no[full].astype(np.int32))], ["h", "doc_id", "line"])


def _bands(buckets: int) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def flush(kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in kept]).ravel()
        e = np.empty(len(keys), _BAND)
        e["s"], e["f"] = keys & tv.U(0xFFFFFFFF), np.repeat(np.concatenate([f for _, f in kept]), BANDS)
        # Numbers of 16 bits are sorted by radix.
        b = ((keys >> tv.U(32)) % tv.U(buckets)).astype(np.int32 if buckets > 1 << 16 else np.uint16)
        order = np.argsort(b, kind="stable")
        b, e = b[order].astype(np.int32), e[order]
        start = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(start[1:], len(b))
        return pa.record_batch([pa.array(b[start]), pa.array([e[i:j].tobytes() for i, j in zip(start, ends, strict=True)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        kept, held = [], 0
        for b in batches:
            fresh = []
            for text in b.column(0).to_pylist():
                for x in forms(text):
                    if x and (key := hash(x)) not in seen:
                        seen.add(key)
                        fresh.append(x)
            if len(seen) > SEEN_LINES:
                seen.clear()
            for part in _chunks(fresh):
                number, keys = band_keys(part)
                kept.append((keys, line_ids(part)[number]))
                held += keys.size
                if held >= ENTRIES_PER_FLUSH:
                    yield flush(kept)
                    kept, held = [], 0
        if kept:
            yield flush(kept)

    return run


def _meet_lines() -> Callable:
    """What meets in a bucket. Most entries meet nothing: those alone in their slot go before all is sorted."""
    meet = _meet(PERCENT, _BAND)

    def run(group: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(group.column("blob").to_pylist()), _BAND)
        bits = min(32, 4 + len(raw).bit_length())
        slot = raw["s"] >> np.uint32(32 - bits)
        often = raw[np.bincount(slot, minlength=1 << bits)[slot] > 1]
        return meet(pa.table({"bucket": group.column("bucket").slice(0, 1), "blob": pa.array([often.tobytes()], pa.binary())}))

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, text) of the wanted lines of each document; what is not the form asked for is left out."""
    for b in batches:
        ids, lines = [], []
        for text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = forms(text)
            for w in want:
                if w["line"] < len(own) and own[w["line"]]:
                    ids.append(w["h"])
                    lines.append(own[w["line"]])
        ok = pa.array(line_ids(lines) == np.array(ids, np.int64), pa.bool_())
        yield pa.record_batch([pa.array(ids, pa.int64()).filter(ok), pa.array(lines, pa.string()).filter(ok)], ["h", "form"])


def _pair_blocks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of pairs of about equal size, so that rows of one length hold little padding."""
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        least = int(size[order[i]])
        j = int(np.searchsorted(size[order], least + least // 8 + 16, "right"))
        j = max(i + 1, min(j, i + PAIR_CELLS // (least + least // 8 + 16)))
        yield order[i:j]
        i = j


def similar_lines(xs: list[str], ys: list[str], percent: int = PERCENT) -> np.ndarray:
    """Whether the shingles of each two non-empty lines have that similarity at least.

    A row holds the shingles of both lines, whose lowest bit tells the line. Sorted, its
    different values are the sizes of both sets, and those without that bit their union.
    """
    size = np.fromiter(map(len, xs), np.int64, len(xs)) + np.fromiter(map(len, ys), np.int64, len(ys))
    ok = np.zeros(len(xs), bool)
    for at in _pair_blocks(size):
        both = [s for i in at.tolist() for s in (xs[i], ys[i])]
        h, begin = line_shingles(both)
        h &= ~tv.U(1)
        h |= np.repeat(np.tile(np.array([0, 1], tv.U), len(at)), np.diff(begin))
        ends = begin[2::2]
        width = np.diff(begin[::2]).max()
        # A row that is shorter repeats its last shingle.
        rows = h[np.minimum(begin[:-1:2, None] + np.arange(width), ends[:, None] - 1)]
        rows.sort(axis=1)
        step = rows[:, 1:] ^ rows[:, :-1]
        sizes = np.count_nonzero(step, axis=1) + 1
        union = np.count_nonzero(step > tv.U(1), axis=1) + 1
        ok[at] = 100 * (sizes - union) >= percent * union
    return ok


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ok = pa.array(similar_lines(b.column(2).to_pylist(), b.column(3).to_pylist()), pa.bool_())
        yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])


def _apart(bits: Sketches, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of shingles in which the lines a[i] and b[i] of a group differ."""
    out, low = np.zeros(len(a), np.int64), np.minimum(bits.size[a], bits.size[b])
    for n in np.unique(low):
        rows, m, step = np.flatnonzero(low == n), bits.level[int(n)], max(1, PAIR_CELLS // int(n))
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            out[at] = np.bitwise_count((m[a[at]] ^ m[b[at]]).view(tv.U)).sum(axis=1)
    return out


def _across_lines(percent: int) -> Callable:
    """As ``ngram_join._across`` with sketches, many members at a time."""

    def run(group: pa.Table) -> pa.Table:
        g = {c: group.column(c).to_numpy() for c in ("fx", "nx", "lab", "i", "j", "blk")}
        fx, nx, lab, one = g["fx"], g["nx"], g["lab"], g["i"][0] == g["j"][0]
        words = group.column("sketch").combine_chunks()
        ends = words.offsets.to_numpy()
        bits = Sketches(np.split(words.values.to_numpy()[ends[0] : ends[-1]], ends[1:-1] - ends[0]))
        left, right = np.flatnonzero(g["blk"] == g["i"]), np.flatnonzero(g["blk"] == g["j"])
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, PAIR_CELLS // max(1, len(right)))
        for k in range(0, len(left), step):
            at = left[k : k + step, None]
            ok = (lab[right] != lab[at]) & (100 * np.minimum(nx[right], nx[at]) >= percent * np.maximum(nx[right], nx[at]))
            if one:
                ok &= fx[right] > fx[at]
            i, j = np.nonzero(ok)
            a, b = at[i, 0], right[j]
            n = nx[a] + nx[b]
            ok = _apart(bits, a, b) <= n - 2 * overlap(n, 0, percent)
            xs.append(fx[a[ok]])
            ys.append(fx[b[ok]])
        return pa.table({"fx": np.concatenate(xs), "fy": np.concatenate(ys)})

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x, at = line_shingles(b.column(1).to_pylist())
        sets = [tv.distinct(x[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        n = pa.array([len(v) for v in sets], pa.int64())
        yield pa.record_batch([b.column(0), n, pa.array([sketch(v) for v in sets], pa.list_(pa.int64()))], ["fx", "nx", "sketch"])


def _forms_of(docs: DataFrame, first: DataFrame, need: DataFrame) -> DataFrame:
    """(h, form) of the forms in ``need``, once each, read where ``first`` has seen them."""
    at = need.join(first, "h").groupBy("at.doc_id").agg(F.collect_list(F.struct("at.line", "h")).alias("want"))
    arrow_rows(docs.sparkSession, TEXT_ROWS)
    texts = docs.join(at.hint("shuffle_hash"), "doc_id").select("text", "want").mapInArrow(_texts, "h long, form string")
    # Few forms come twice (of rows that share a doc_id): dealt out first, they are sorted once.
    return cut(texts.repartition("h").groupBy("h").agg(F.first("form").alias("form")))


def _linked(forms_: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verified (u, v) of candidate pairs, given the text of each form."""
    side = lambda s: forms_.select(F.col("h").alias("f" + s), F.col("form").alias("t" + s))
    met = pairs.select("fx", "fy").distinct().join(side("x"), "fx").join(side("y"), "fy").select("fx", "fy", "tx", "ty")
    arrow_rows(pairs.sparkSession, PAIR_ROWS)
    return met.mapInArrow(_verify, "u long, v long")


def line_components(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(h, component) of every form that is linked to another one.

    ``first`` has (h, at): the place (doc_id, line) where each form stands first.
    """
    spark = docs.sparkSession
    total = first.count() * BANDS
    buckets = max(shuffle_partitions(spark), total // ENTRIES_PER_BUCKET + 1)
    arrow_rows(spark, TEXT_ROWS)
    dealt = docs.select("text").mapInArrow(_bands(buckets), "bucket int, blob binary")
    met = cut(dealt.groupBy("bucket").applyInArrow(_meet_lines(), "run long, fx long, nx long, px int, fy long, ny long"))
    # Texts of all that met another form are read once, for this and the later rounds.
    forms_ = _forms_of(docs, first, met.select(F.col("fx").alias("h")).union(met.where("fy is not null").select("fy")).distinct())
    links = cut(_linked(forms_, met.where("run is null")))
    comp = cut(components(links))
    late = met.where("run is not null").select("run", "fx", "nx", "px")
    for last in (False, True) if late.head(1) else ():
        labelled = late.join(comp, F.col("fx") == F.col("id"), "left").select("run", "fx", "nx", "px", F.coalesce("component", "fx").alias("lab"))
        mixed = labelled.groupBy("run").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
        mixed = cut(mixed.select("run", "m"))
        if not mixed.head(1):
            break
        members = labelled.join(mixed, "run")
        if last:
            # Sizes and parity sketches keep all but likely pairs of a group from being made.
            known = forms_.join(members.select(F.col("fx").alias("h")).distinct(), "h", "left_semi").select("h", "form")
            known = known.mapInArrow(_sketched, "fx long, nx long, sketch array<long>")
            more = _cross_pairs(members.drop("nx").join(known, "fx"), PERCENT, _across_lines)
        else:
            more = _pivot_pairs(members, PERCENT)
        links = cut(links.union(_linked(forms_, more)))
        comp = cut(components(links))
    return comp.select(F.col("id").alias("h"), "component")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    arrow_rows(spark, TEXT_ROWS)
    lines = cut(docs.where("doc_id is not null").mapInArrow(_occurrences, "h long, doc_id long, line int"))
    at = F.struct("doc_id", "line")
    first = cut(lines.groupBy("h").agg(F.min(at).alias("at"), F.count("*").alias("n")))
    comp = line_components(docs, first.select("h", "at"))
    # Forms that stand once and are linked to none stay.
    met = cut(first.join(comp, "h", "left").where("n > 1 or component is not null").select("h", "at", F.coalesce("component", "h").alias("label")))
    best = met.groupBy("label").agg(F.min("at").alias("best"))
    keep = met.join(best, "label").select("h", "best")
    gone = lines.join(keep, "h").where(at != F.col("best")).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    out = docs.join(gone.hint("shuffle_hash"), "doc_id", "left").withColumn("parts", F.split("text", "\n"))
    gone_ = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter("parts", lambda x, i: ~F.array_contains(gone_, i)), "\n"))
    return out.select("doc_id", F.size("parts").cast("long").alias("n_lines"), F.size(gone_).cast("long").alias("n_removed"), kept.alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
