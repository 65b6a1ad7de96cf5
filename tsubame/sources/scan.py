"""Large text files of a lexicon, read in splits: CSV with quoted line breaks, and cost matrices.

Splits are cut at line breaks by Spark's text reader. What a line of CSV means depends on
whether it begins inside a quoted field, so a first pass finds, for each split and both
beginnings, how it ends and how many records begin in it; a running fold over these few
rows gives every split its beginning and its first record number. A second pass then cuts
all splits into records at once. Only a record that crosses a border of splits is put
together by a shuffle.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_LINES = 10_000


def lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(file, block, no, value) of every line; block is the split's offset in its file, no rises within it."""
    try:
        rows = spark.read.options(**options).text(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(str(paths)) from None
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), "value")


# CSV.


def open_after(line: str, quoted: bool) -> bool:
    """Whether a quoted field is still open behind a line that begins inside one, or not.

    A quote opens a field only at its start; inside, two quotes are one character; what
    follows the closing quote up to the comma is taken as it is.
    """
    at = 0
    while True:
        if not quoted:
            if line.startswith('"', at):
                at, quoted = at + 1, True
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        end = line.find('"', at)
        if end < 0:
            return True
        if line.startswith('"', end + 1):
            at = end + 2
            continue
        quoted = False
        at = line.find(",", end + 1) + 1
        if not at:
            return False


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: is it UTF-8, and for both beginnings: is a field open at its end, and how many records begin."""
    found: dict[tuple[str, int], list] = {}
    for b in batches:
        for file, block, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            state = found.setdefault((file, block), [True, False, True, 0, 0])
            if state[0]:
                try:
                    value.decode()
                except UnicodeDecodeError:
                    state[0] = False
            value = value.decode("latin-1")
            for i in (0, 1):
                is_open = state[1 + i]
                state[3 + i] += not is_open
                # Most lines have no quote and leave things as they are.
                state[1 + i] = open_after(value, is_open) if '"' in value else is_open
    names = ["file", "block", "utf8", "end0", "end1", "n0", "n1"]
    yield pa.RecordBatch.from_pylist([dict(zip(names, (*k, *v), strict=True)) for k, v in found.items()], pa.schema([(n, pa.string() if n == "file" else pa.int64() if n in ("block", "n0", "n1") else pa.bool_()) for n in names]))


def _second_pass(plan: dict[tuple[str, int], tuple[bool, int]]) -> Callable:
    """(file, rec, part, value): whole records have no part, fragments the place of their split and line."""
    names = ["file", "rec", "part", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, quoted, rec, held, entered = None, False, 0, [], False
        out: list[tuple] = []

        def close(whole: bool) -> None:
            # A record that began in an earlier split, or goes on in the next one, is a fragment.
            if held:
                out.append((at[0], rec, None if whole and not entered else at[1], "\n".join(held)))
                held.clear()

        for b in batches:
            for file, block, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, block) != at:
                    close(not quoted)
                    at = (file, block)
                    quoted, rec = plan[at]
                    entered = quoted
                elif not quoted:
                    close(True)
                if not quoted:
                    rec += 1
                    entered = False
                # One character a byte; what the bytes mean is told for whole records later.
                value = value.decode("latin-1")
                held.append(value)
                quoted = open_after(value, quoted) if quoted or '"' in value else False
            if len(out) >= BATCH_LINES:
                yield pa.record_batch([pa.array(x) for x in _columns(out)], names)
                out.clear()
        close(not quoted)
        if out:
            yield pa.record_batch([pa.array(x) for x in _columns(out)], names)

    return run


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def csv_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, rec, value): the text of every record, numbered from 1 in its file, blank ones included.

    A file is UTF-8 if all of it is, or else EUC-JP with replacement of what is not valid.
    """
    # The text reader hands bytes through, so the encoding can be told for whole files.
    rows = lines(spark, paths, lineSep="\n").select("file", "block", F.col("value").cast("binary").alias("value"))
    splits = rows.mapInArrow(_first_pass, "file string, block long, utf8 boolean, end0 boolean, end1 boolean, n0 long, n1 long").collect()
    plan, now = {}, {}
    utf8 = {f: all(s["utf8"] for s in splits if s["file"] == f) for f in {s["file"] for s in splits}}
    for s in sorted(splits, key=lambda s: (s["file"], s["block"])):
        quoted, count = now.get(s["file"], (False, 0))
        plan[s["file"], s["block"]] = quoted, count
        now[s["file"]] = (s["end1"], count + s["n1"]) if quoted else (s["end0"], count + s["n0"])
    cut_up = rows.mapInArrow(_second_pass(plan), "file string, rec long, part long, value string")
    joined = cut_up.where("part is not null").groupBy("file", "rec").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), "\n").alias("value"))
    whole = cut_up.where("part is null").select("file", "rec", "value").unionByName(joined)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [v.encode("latin-1").decode(*(() if utf8[f] else ("euc_jp", "replace"))) for f, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string())], ["file", "rec", "value"])

    return whole.mapInArrow(decoded, "file string, rec long, value string")


def csv_row(value: str) -> list[str]:
    """Fields of one record."""
    return next(csv.reader(io.StringIO(value, newline="")), [])


# Cost matrices.


def matrix(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """(left size, right size, cells (right_id, left_id, cost)) of a matrix file or a folder of its parts.

    The last of duplicate cells counts, by (file, split, line). Lines of fewer than three
    fields and comments are left out; numbers and cells outside their range are an error.
    """
    from tsubame.sources.definitions import LexiconError, _int

    rows = lines(spark, path)
    order = F.struct("file", "block", "no")
    head = rows.orderBy("file", "block", "no").limit(1).collect()
    sizes = head[0]["value"].split() if head else []
    if len(sizes) < 2:
        raise LexiconError(f"{path}:1: two sizes are needed")
    left, right = (_int(x, 0, 65_535, f"{path}:1") for x in sizes[:2])
    first = (F.col("file") == head[0]["file"]) & (F.col("block") == head[0]["block"]) & (F.col("no") == head[0]["no"])
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    cells = rows.where(~first).withColumn("f", part).where((F.size("f") >= 3) & ~F.startswith(F.get("f", 0), F.lit("#")))
    number = lambda i: F.when(F.get("f", i).rlike(r"^[+-]?\d{1,9}$"), F.get("f", i)).cast("int")
    cells = cells.select(order.alias("at"), "f", number(0).alias("r"), number(1).alias("k"), number(2).alias("c"))

    def wrong(name: str, i: int, lo: int, hi: int) -> Column:
        said = F.concat(F.lit("'"), F.get("f", i), F.lit(f"' is not a number from {lo} to {hi}"))
        return F.when(~F.coalesce(F.col(name).between(lo, hi), F.lit(False)), said)

    flat = F.col("r") * F.lit(left).cast("long") + F.col("k")
    outside = F.when(flat >= left * right, F.concat(F.lit("("), F.col("r").cast("string"), F.lit(", "), F.col("k").cast("string"), F.lit(f") lies outside {left} x {right}")))
    said = F.coalesce(wrong("r", 0, 0, 65_535), wrong("k", 1, 0, 65_535), outside, wrong("c", 2, -32_768, 32_767))
    bad = cells.withColumn("said", said).agg(F.min(F.when(F.col("said").isNotNull(), F.struct("at", "said"))).alias("x")).first()["x"]
    if bad:
        # Its line: those of earlier splits of its file, and those before it in its own.
        own = (F.col("block") < bad["at"]["block"]) | ((F.col("block") == bad["at"]["block"]) & (F.col("no") <= bad["at"]["no"]))
        raise LexiconError(f"{path}:{rows.where((F.col('file') == bad['at']['file']) & own).count()}: {bad['said']}")
    cells = cells.groupBy(flat.alias("flat")).agg(F.max_by("c", "at").cast("short").alias("cost"))
    return left, right, cells.select(F.floor(F.col("flat") / left).cast("int").alias("right_id"), (F.col("flat") % left).cast("int").alias("left_id"), "cost")
