"""Agreement of two segmentations of the same texts, aligned inside each row.

Both sides are token arrays with byte offsets. A walk over both in step gives the minimal
blocks between common boundaries; counts, precision and recall follow from them. Nothing
is shuffled, and texts of any number travel in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubame.operators.analyzer import Analyzer

BLOCK = "array<struct<start:bigint,end:bigint,left:array<string>,right:array<string>,same_reading:boolean,same_pos:boolean>>"
_BLOCK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("same_reading", pa.bool_()), ("same_pos", pa.bool_())]))


_SIDE = ("surface", "reading", "pos")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), *((f"{s}_{c}", pa.string()) for s in ("left", "right") for c in _SIDE), ("status", pa.string()), ("same_reading", pa.bool_()), ("same_pos", pa.bool_())]))
SPAN = "array<struct<start:bigint,end:bigint," + "".join(f"{s}_{c}:string," for s in ("left", "right") for c in _SIDE) + "status:string,same_reading:boolean,same_pos:boolean>>"


class Alignment:
    """The common ends of two token arrays a row, and the tokens between them."""

    def __init__(self, left: pa.ListArray, right: pa.ListArray) -> None:
        self.rows = len(left)
        self.valid = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False)
        self.items, self.row, end = [], [], []
        for tokens in (left, right):
            size = np.where(self.valid, tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            self.items.append(tokens.filter(pa.array(self.valid)).flatten())
            self.row.append(np.repeat(np.arange(self.rows), size))
            end.append(self.items[-1].field("end").to_numpy().astype(np.int64))
        self.width = 1 + max((int(e.max(initial=0)) for e in end), default=0)
        keys = [r * self.width + e for r, e in zip(self.row, end, strict=True)]
        # Ends rise inside a row, so a walk in step meets the common ones: they close the blocks.
        self.common = np.intersect1d(*keys)
        self.block = [np.searchsorted(self.common, k) for k in keys]
        n = len(self.common)
        self.first = [np.searchsorted(b, np.arange(n)) for b in self.block]
        # A span is common exactly where a block has one token on both sides.
        self.single = np.ones(n, bool)
        for b in self.block:
            self.single &= np.bincount(b, minlength=n + 1)[:n] == 1

    def same(self, field: str) -> np.ndarray:
        """Whether the first tokens of each block agree in a field."""
        l, r = (i.field(field).take(pa.array(f)) for i, f in zip(self.items, self.first, strict=True))
        return pc.equal(l, r).to_numpy(zero_copy_only=False).astype(bool) if len(self.common) else np.zeros(0, bool)

    def listed(self, row: np.ndarray, fields: list, kind: pa.ListType) -> pa.ListArray:
        """Columns, in order of rows, as a list a row; null where a side is null."""
        items = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(self.rows + 1)), pa.int32(), mask=np.append(~self.valid, False)), items)


def _whole(x: pa.Array) -> pa.ListArray:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def aligned(left: pa.Array, right: pa.Array) -> pa.ListArray:
    """Blocks of each row."""
    a = Alignment(_whole(left), _whole(right))
    n, sides = len(a.common), []
    for items, b in zip(a.items, a.block, strict=True):
        inside = b < n
        sides.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(b[inside], np.arange(n + 1)), pa.int32()), items.field("surface").filter(pa.array(inside))))
    # Only a block of one token on both sides has readings to compare.
    same = [pa.array(a.same(f), pa.bool_(), mask=~a.single) for f in ("reading", "pos")]
    row, end = np.divmod(a.common, a.width)
    start = np.concatenate([[0], end[:-1]]) if n else end
    start[np.flatnonzero(np.diff(row, prepend=-1))] = 0
    return a.listed(row, [pa.array(start), pa.array(end), *sides, *same], _BLOCK)


def spans(left: pa.Array, right: pa.Array) -> pa.ListArray:
    """Spans of each row: those of the left side with their partners, and those of the right side only."""
    a = Alignment(_whole(left), _whole(right))
    hit = [np.append(a.single, False)[b] for b in a.block]
    l, r = a.items
    partner = pa.array(np.append(a.first[1], 0)[a.block[0]], pa.int64(), mask=~hit[0])
    only = np.flatnonzero(~hit[1])
    void = pa.nulls(len(only), pa.string())
    others = r.take(pa.array(only))
    cols = {c: pa.concat_arrays([l.field(c), others.field(c)]).cast(pa.int64()) for c in ("start", "end")}
    cols |= {f"left_{c}": pa.concat_arrays([l.field(c), void]) for c in _SIDE}
    cols |= {f"right_{c}": pa.concat_arrays([r.field(c).take(partner), others.field(c)]) for c in _SIDE}
    cols["status"] = pa.array(np.concatenate([np.where(hit[0], "both", "left_only"), np.full(len(only), "right_only")]).tolist(), pa.string())
    for f in ("reading", "pos"):
        cols[f"same_{f}"] = pa.array(np.append(np.append(a.same(f), False)[a.block[0]], np.zeros(len(only), bool)), pa.bool_(), mask=np.append(~hit[0], np.ones(len(only), bool)))
    row = np.concatenate([a.row[0], a.row[1][only]])
    order = np.argsort(row, kind="stable")
    return a.listed(row[order], [cols[f.name].take(pa.array(order)) for f in _SPAN.value_type], _SPAN)


def placed(lists: pa.Array) -> pa.ListArray:
    """Token lists of lists of surfaces that leave no gap, without readings and parts of speech."""
    lists = _whole(lists)
    flat, size = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(length)])
    begin = np.concatenate([[0], np.cumsum(size)])
    start = total[:-1] - np.repeat(total[begin[:-1]], size)
    void = pa.array([""] * len(flat), pa.string())
    items = pa.StructArray.from_arrays([flat, pa.array(start), pa.array(start + length), void, void], names=["surface", "start", "end", "reading", "pos"])
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32(), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False)), items)


def surface_scores(left: Column | str, right: Column | str) -> Column:
    """Words, blocks and common words of two lists of surfaces of one text: struct of left_words, right_words, blocks, same_words."""

    @F.arrow_udf("struct<left_words:bigint,right_words:bigint,blocks:bigint,same_words:bigint>")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        x = Alignment(placed(a), placed(b))
        per_row = lambda rows: pa.array(np.bincount(rows, minlength=x.rows), pa.int64())
        row = x.common // x.width
        return pa.StructArray.from_arrays([per_row(x.row[0]), per_row(x.row[1]), per_row(row), per_row(row[x.single])], names=["left_words", "right_words", "blocks", "same_words"])

    return count(left, right)


def blocks(left: Column | str, right: Column | str) -> Column:
    """Minimal aligned blocks (start, end, left and right surfaces, agreement) of two token arrays.

    Both sides must cover the same text without a gap, as tokens do.
    """

    @F.arrow_udf(BLOCK)
    def align(a: pa.Array, b: pa.Array) -> pa.Array:
        return aligned(a, b)

    return align(left, right)


def scores(found: Column, left: Column, right: Column) -> Column:
    """Counts of a row's blocks, and precision, recall and F of boundaries and words, the left side being right."""
    count = lambda test: F.size(F.filter(found, test)).cast("long")
    n = {"left_words": F.size(left).cast("long"), "right_words": F.size(right).cast("long"), "blocks": F.size(found).cast("long")}
    n["same_words"] = count(lambda b: (F.size(b["left"]) == 1) & (F.size(b["right"]) == 1))
    n["same_readings"] = count(lambda b: F.coalesce(b["same_reading"], F.lit(False)))
    n["same_pos"] = count(lambda b: F.coalesce(b["same_pos"], F.lit(False)))
    for kind, hit in (("boundary", n["blocks"]), ("word", n["same_words"])):
        n[f"{kind}_precision"] = F.try_divide(hit, n["right_words"])
        n[f"{kind}_recall"] = F.try_divide(hit, n["left_words"])
        n[f"{kind}_f"] = F.try_divide(2 * hit, n["left_words"] + n["right_words"])
    return F.struct(*[c.alias(k) for k, c in n.items()])


def align(df: DataFrame, left: Analyzer, right: Analyzer, text: str = "text") -> DataFrame:
    """``df`` with ``blocks`` and ``scores`` of two analyzers on its text."""
    both = df.withColumns({"_left": left.tokens(F.col(text)), "_right": right.tokens(F.col(text))})
    both = both.withColumn("blocks", blocks("_left", "_right"))
    return both.withColumn("scores", scores(F.col("blocks"), F.col("_left"), F.col("_right"))).drop("_left", "_right")


def compare(df: DataFrame, left: Analyzer, right: Analyzer, text: str, keys: list[str]) -> DataFrame:
    """Every span that either one finds: surfaces, readings and what agrees.

    ``status`` is both, left_only or right_only; same_reading and same_pos are set for both.
    Spans are matched inside the row by their places in both arrays.
    """

    @F.arrow_udf(SPAN)
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        return spans(a, b)

    both = df.select(*keys, F.explode(found(left.tokens(F.col(text)), right.tokens(F.col(text)))).alias("s"))
    return both.select(*keys, "s.*")


def agreement(spans: DataFrame) -> DataFrame:
    """One row over the spans of ``compare``: how many both find, and where readings and parts of speech agree."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    status = {s: count(F.col("status") == s).alias(s) for s in ("both", "left_only", "right_only")}
    same = [count(F.col(c)).alias(c) for c in ("same_reading", "same_pos")]
    return spans.agg(F.count("*").alias("spans"), *status.values(), *same)


def summary(df: DataFrame, analyzers: dict[str, Analyzer], text: str, keys: list[str]) -> DataFrame:
    """(keys, engine, segmentation, reading) of each text and analyzer."""
    out = None
    for name, a in analyzers.items():
        t = a.tokenize_batch(df, text, "_t")
        one = t.select(*keys, F.lit(name).alias("engine"), F.array_join(F.transform("_t", lambda x: x["surface"]), " | ").alias("segmentation"), F.array_join(F.transform("_t", lambda x: x["reading"]), "").alias("reading"))
        out = one if out is None else out.unionByName(one)
    return out
