"""Readers of the definition files of a lexicon: CSV, classes, templates.

CSV files are read in splits (see ``scan``) and keep their order as (file, record). Class
and template files are small and read on the driver, as their order is their meaning.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.sources.scan import csv_records, csv_row

ENTRY = ["surface", "left_id", "right_id", "cost", "pos", "base_form", "reading", "pronunciation"]


class LexiconError(ValueError):
    """A lexicon file that cannot be used; the message names the place."""


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole file, from any store that Spark reads; FileNotFoundError if there is none."""
    try:
        rows = spark.read.format("binaryFile").load(path).select("content").head(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0][0])


def list_csv(spark: SparkSession, folder: str, exclude: Iterable[str] = ()) -> list[str]:
    """CSV files of a folder, without those below and those of excluded names, in alphabetical order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()
    paths = sorted(r[0] for r in found if r[0].rsplit("/", 1)[-1] not in set(exclude))
    if not paths:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return paths


def csv_fields(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, idx, f) of every row of these CSV files: its fields, in any number; idx is the record's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([csv_row(v) or None for v in b.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([b.column(0), b.column(1), f], ["file", "idx", "f"])

    return csv_records(spark, paths).mapInArrow(run, "file string, idx long, f array<string>").where("f is not null")


def csv_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, rec, error, fields of an entry) of these lexicon CSV files; a record that is unusable has only its error."""
    kinds = [pa.int32() if n in ("left_id", "right_id", "cost") else pa.string() for n in ENTRY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for file, rec, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row := csv_row(value):
                    try:
                        out.append((file, rec, None, *entry_of(row, f"{file}:{rec}")))
                    except LexiconError as e:
                        out.append((file, rec, str(e), *[None] * len(ENTRY)))
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate([pa.string(), pa.int64(), pa.string(), *kinds])]
            yield pa.record_batch(cols, ["file", "rec", "error", *ENTRY])

    ddl = "file string, rec long, error string, surface string, left_id int, right_id int, cost int, pos string, base_form string, reading string, pronunciation string"
    return csv_records(spark, paths).mapInArrow(run, ddl).withColumn("cost", F.col("cost").cast("short"))


def decode(raw: bytes) -> str:
    """UTF-8, or else EUC-JP with replacement of what is not valid."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("euc_jp", "replace")


def _int(text: str, lo: int, hi: int, place: str) -> int:
    try:
        value = int(text)
    except ValueError:
        value = lo - 1
    if not lo <= value <= hi or not re.fullmatch(r"[+-]?\d+", text):
        raise LexiconError(f"{place}: {text!r} is not a number from {lo} to {hi}")
    return value


def entry_of(row: list[str], at: str) -> tuple:
    """(surface, left_id, right_id, cost, pos, base_form, reading, pronunciation) of a row of fields.

    A base form that is missing is the surface; one that is empty stays empty.
    """
    if len(row) < 5:
        raise LexiconError(f"{at}: {len(row)} columns, at least 5 are needed")
    if row[0] == "":
        raise LexiconError(f"{at}: empty surface")
    ids = [_int(row[i], 0, 65_535, f"{at}:{f}") for i, f in ((1, "left_id"), (2, "right_id"))]
    cost = _int(row[3], -32_768, 32_767, f"{at}:cost")
    get = lambda i, default="": row[i] if len(row) > i else default
    return (row[0], *ids, cost, ",".join(row[4:8]), get(10, row[0]), get(11), get(12))


def lexicon_rows(text: str, name: str = "lexicon") -> list[tuple]:
    """Entries of a small CSV text, on the driver."""
    return [entry_of(row, f"{name}:{no}") for no, row in enumerate(csv.reader(io.StringIO(text, newline="")), 1) if row]


def parse_range(text: str) -> tuple[int, int] | None:
    """(first, last) of ``0xA`` or ``0xA..0xB``; None for anything else."""
    m = re.fullmatch(r"0[xX]([0-9A-Fa-f]+)(?:\.\.0[xX]([0-9A-Fa-f]+))?", text)
    if not m:
        return None
    a = int(m[1], 16)
    return a, int(m[2], 16) if m[2] else a


def char_rows(text: str) -> tuple[list[tuple], list[tuple]] | None:
    """([(name, invoke, group, length)], [(start, end, class)]); None without classes."""
    classes, ranges, in_ranges = [], [], False
    for raw in text.splitlines():
        part = raw.split("#", 1)[0].split()
        if not part:
            continue
        if part[0].startswith("0x"):
            in_ranges = True
            span = parse_range(part[0])
            if span and len(part) > 1:
                ranges.append((*span, part[1]))
        elif not in_ranges and len(part) >= 4 and part[3].isdigit():
            classes.append((part[0], part[1] == "1", part[2] == "1", int(part[3])))
    return (classes, ranges) if classes else None


def unk_rows(text: str, name: str = "unk.def") -> list[tuple]:
    """(class, left_id, right_id, cost, pos) in file order."""
    out = []
    for no, row in enumerate(csv.reader(io.StringIO(text, newline="")), 1):
        if len(row) < 5:
            continue
        ids = [_int(row[i], 0, 65_535, f"{name}:{no}") for i in (1, 2)]
        out.append((row[0], *ids, _int(row[3], -32_768, 32_767, f"{name}:{no}"), ",".join(row[4:8])))
    return out
