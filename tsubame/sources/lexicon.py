"""The lexicon: building, parquet bundle, merge, repair and information."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame import schema
from tsubame.functions.charclass import DEFAULT_CLASSES, Classifier, class_of_type, TYPES
from tsubame.functions.readings import is_katakana
from tsubame.session import cut, numbered, put
from tsubame.sources import definitions as d
from tsubame.sources.definitions import read_bytes
from tsubame.sources.scan import matrix

_FEATURE = ["pos", "base_form", "reading", "pronunciation"]
_MANIFEST = "manifest-"
TABLES = {"entries": schema.LEXICON, "matrix": schema.MATRIX, "char_class": schema.CHAR_CLASS, "char_range": schema.CHAR_RANGE, "unk": schema.UNK}


class Lexicon:
    """Entries, connection costs, classes, ranges and templates, as DataFrames."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], left_size: int, right_size: int, path: str | None = None) -> None:
        self.spark, self.tables, self.left_size, self.right_size, self.path = spark, tables, left_size, right_size, path

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def classifier(self) -> Classifier:
        classes = {r[0]: (r[1], r[2], r[3]) for r in self.char_class.select("name", "invoke", "group", "length").collect()}
        ranges = [tuple(r) for r in self.char_range.orderBy("ord").select("start", "end", "class").collect()]
        return Classifier(classes, ranges)

    def counts(self) -> tuple[int, int, int]:
        """(entries, distinct strings, distinct feature tuples)."""
        e = self.entries
        named = [F.col(c).alias("s") for c in ("surface", "pos", "base_form", "reading", "pronunciation")]
        strings = e.select(named[0])
        for c in named[1:]:
            strings = strings.union(e.select(c))
        strings = strings.union(self.unk.select("pos")).union(self.char_class.select("name"))
        features = e.select("pos", "base_form", "reading", "pronunciation").distinct()
        return e.count(), strings.distinct().count(), features.count()

    def info(self) -> DataFrame:
        """One row: entries, strings, features, matrix sizes and seconds to count them."""
        began = time.time()
        n = self.counts()
        row = (*n, self.left_size, self.right_size, time.time() - began)
        return self.spark.createDataFrame([row], "entries long, strings long, features long, left_size int, right_size int, load_seconds double")

    def pools(self) -> dict[str, DataFrame]:
        """``strings`` (id, value) and ``features`` (id, pos, base_form, reading, pronunciation), once each.

        Ids are dense, by first appearance in the order of entries and their fields.
        """
        e = self.entries
        fields = ["surface", *_FEATURE]
        strings = e.select("entry_id", F.posexplode(F.array(*fields)).alias("_field", "value"))
        out = {}
        for name, rows, by in (("strings", strings.withColumn("_first", F.struct("entry_id", "_field")), ["value"]), ("features", e.withColumn("_first", F.struct("entry_id")), _FEATURE)):
            first = rows.groupBy(*by).agg(F.min("_first").alias("_first"))
            out[name] = numbered(first, ["_first"], "id").select(F.col("id").cast("int").alias("id"), *by)
        return out

    def pool(self, name: str) -> DataFrame:
        """A pool as it lies in the bundle, or made anew."""
        return self.spark.read.parquet(f"{self.path}/{name}") if self.path else self.pools()[name]

    def commit(self, path: str, after: int | None = None) -> int:
        """One more version of the bundle at ``path``; returns its number.

        A version is a folder of its own, and counts when its manifest is made, which a store
        lets only one writer do: of two that follow version ``after``, the second is refused.
        Readers keep the version that they have opened.
        """
        number = (latest(self.spark, path) if after is None else after) + 1
        folder = f"versions/{number:08d}-{uuid.uuid4().hex[:8]}"
        self.write(f"{path}/{folder}")
        try:
            put(self.spark, f"{path}/{_MANIFEST}{number:08d}", folder.encode(), overwrite=False)
        except Py4JJavaError as e:
            raise d.LexiconError(f"{path}: another writer has made version {number} ({str(e.java_exception)[:80]})") from None
        return number

    def write(self, path: str) -> None:
        """A new bundle below ``path``; existing ones are never overwritten in place."""
        for name, df in (self.tables | self.pools()).items():
            df.write.parquet(f"{path}/{name}")
        meta = (schema.FORMAT, schema.VERSION, self.left_size, self.right_size, *self.counts())
        self.spark.createDataFrame([meta], schema.META).coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Lexicon:
        """Opens a bundle, the latest version of one that has versions; a LexiconError says what is wrong with another folder."""
        if number := latest(spark, path):
            path = f"{path}/{read_bytes(spark, f'{path}/{_MANIFEST}{number:08d}').decode()}"
        try:
            meta = spark.read.parquet(f"{path}/meta").head(1)
        except Exception as e:
            raise d.LexiconError(f"{path}: no lexicon bundle ({str(e)[:120]})") from None
        if not meta or "format" not in meta[0] or meta[0]["format"] != schema.FORMAT:
            raise d.LexiconError(f"{path}: not a lexicon bundle")
        if meta[0]["version"] != schema.VERSION:
            raise d.LexiconError(f"{path}: version {meta[0]['version']} is not supported")
        tables = {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in TABLES.items()}
        return Lexicon(spark, tables, meta[0]["left_size"], meta[0]["right_size"], path)

    def merged(self, other: Lexicon) -> Lexicon:
        """All entries of both, those of ``other`` behind; nothing is de-duplicated.

        Costs and classes are this lexicon's, templates those of both.
        """
        top = self.entries.agg(F.coalesce(F.max("entry_id") + 1, F.lit(0)).alias("n")).first()[0]
        more = other.entries.withColumn("entry_id", (F.col("entry_id") + top).cast("int"))
        unk_top = self.unk.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        unk = self.unk.unionByName(other.unk.withColumn("ord", (F.col("ord") + unk_top).cast("int")))
        return Lexicon(self.spark, {**self.tables, "entries": self.entries.unionByName(more), "unk": unk}, self.left_size, self.right_size)

    def repaired(self) -> tuple[Lexicon, int]:
        """Pronunciations that are not katakana become the reading, where that is; with their number."""
        bad = (F.col("pronunciation") != "") & ~is_katakana(F.col("pronunciation")) & is_katakana(F.col("reading"))
        fixed = self.entries.withColumn("pronunciation", F.when(bad, F.col("reading")).otherwise(F.col("pronunciation")))
        return Lexicon(self.spark, {**self.tables, "entries": fixed}, self.left_size, self.right_size), self.entries.where(bad).count()

    def ids_out_of_range(self) -> DataFrame:
        """Entries whose ids lie outside the matrix; decoding gives them cost 0."""
        return self.entries.where((F.col("left_id") >= self.left_size) | (F.col("right_id") >= self.right_size))


def latest(spark: SparkSession, path: str) -> int:
    """Number of the latest version below ``path``; 0 if it has none."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.Path(f"{path}/{_MANIFEST}*")) or []
    return max((int(f.getPath().getName()[len(_MANIFEST) :]) for f in found), default=0)


class LexiconBuilder:
    """Collects sources in order and builds one lexicon; usable once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._parts: list[list[tuple] | DataFrame] = []
        self._matrix: tuple[int, int, dict | DataFrame] | None = None
        self._classifier: Classifier | None = None
        self._unk: list[tuple] = []
        self._done = False

    def _open(self) -> LexiconBuilder:
        if self._done:
            raise RuntimeError("this builder has already built its lexicon")
        return self

    def load_lexicon(self, path: str, reset_char_def: bool = False) -> LexiconBuilder:
        """Takes all entries and templates of a bundle, and its costs if none are set.

        Its classes and ranges are kept, unless ``reset_char_def`` asks for the defaults.
        """
        base = Lexicon.read(self._open().spark, path)
        if self._matrix is None:
            self._matrix = (base.left_size, base.right_size, base.matrix)
        self._parts.append(base.entries)
        self._unk += [(r["class"], r["left_id"], r["right_id"], r["cost"], r["pos"]) for r in base.unk.orderBy("ord").collect()]
        if not reset_char_def and self._classifier is None:
            self._classifier = base.classifier()
        return self

    def add_entries(self, rows: Iterable[tuple]) -> LexiconBuilder:
        """(surface, left_id, right_id, cost, pos, base_form, reading, pronunciation) rows."""
        part = [tuple(r) for r in rows]
        if any(r[0] == "" for r in part):
            raise d.LexiconError("empty surface")
        self._open()._parts.append(part)
        return self

    def _add_files(self, paths: list[str]) -> LexiconBuilder:
        """Entries of CSV files in this order; they are parsed once, into the shared folder."""
        found = cut(d.csv_entries(self._open().spark, paths))
        first = found.agg(F.min(F.when(F.col("error").isNotNull(), F.struct("file", "rec", "error"))).alias("x")).first()["x"]
        if first:
            raise d.LexiconError(first["error"])
        self._parts.append(numbered(found, ["file", "rec"], "entry_id").select("entry_id", *d.ENTRY))
        return self

    def add_frame(self, rows: DataFrame, order: list[str]) -> LexiconBuilder:
        """Entries of a DataFrame with the columns of an entry, numbered in the order of ``order``."""
        rows = rows.withColumns({"left_id": F.col("left_id").cast("int"), "right_id": F.col("right_id").cast("int"), "cost": F.col("cost").cast("short")})
        rows = cut(rows)
        if rows.where("surface is null or surface = ''").head(1):
            raise d.LexiconError("empty surface")
        self._open()._parts.append(numbered(rows, order, "entry_id").select("entry_id", *d.ENTRY))
        return self

    def add_csv(self, path: str) -> LexiconBuilder:
        return self._add_files([path])

    def add_csv_dir(self, folder: str, exclude: Iterable[str] = ()) -> LexiconBuilder:
        return self._add_files(d.list_csv(self._open().spark, folder, exclude))

    def set_matrix(self, left: int, right: int, costs: dict[tuple[int, int], int] | DataFrame) -> LexiconBuilder:
        """Costs by (right_id, left_id), or as a DataFrame (right_id, left_id, cost)."""
        if left != right:
            warnings.warn(f"the matrix is {left} x {right}, not square", stacklevel=2)
        self._open()._matrix = (left, right, costs if isinstance(costs, DataFrame) else dict(costs))
        return self

    def load_matrix(self, path: str) -> LexiconBuilder:
        return self.set_matrix(*matrix(self._open().spark, path))

    def set_classifier(self, classifier: Classifier) -> LexiconBuilder:
        self._open()._classifier = classifier
        return self

    def load_char_def(self, path: str) -> LexiconBuilder:
        found = d.char_rows(d.decode(d.read_bytes(self._open().spark, path)))
        if found:
            self._classifier = Classifier({n: (i, g, k) for n, i, g, k in found[0]}, found[1])
        return self

    def add_unk(self, rows: Iterable[tuple]) -> LexiconBuilder:
        self._open()._unk += list(rows)
        return self

    def load_unk(self, path: str) -> LexiconBuilder:
        return self.add_unk(d.unk_rows(d.decode(d.read_bytes(self._open().spark, path)), path))

    def build(self) -> Lexicon:
        self._open()._done = True
        left, right, costs = self._matrix or (1, 1, {})
        cells = costs if isinstance(costs, DataFrame) else [(r, k, v) for (r, k), v in costs.items()]
        c = self._classifier or Classifier.default()
        usable = {class_of_type(t) for t in TYPES}
        rows = {
            "entries": self._entries(),
            "matrix": cells,
            "char_class": [(n, *v) for n, v in c.classes.items()],
            "char_range": [(i, *r) for i, r in enumerate(c.ranges)],
            "unk": [(u[0], i, *u[1:]) for i, u in enumerate(dict.fromkeys(u for u in self._unk if u[0] in usable))],
        }
        tables = {n: v if isinstance(v, DataFrame) else self.spark.createDataFrame(v, TABLES[n]) for n, v in rows.items()}
        return Lexicon(self.spark, tables, left, right)

    def _entries(self) -> DataFrame:
        """All parts in order, numbered on from one to the next."""
        out, top = None, 0
        for part in [x for x in self._parts if isinstance(x, DataFrame) or x] or [[]]:
            if isinstance(part, DataFrame):
                one = part.withColumn("entry_id", (F.col("entry_id") + top).cast("int"))
                top = one.agg(F.coalesce(F.max("entry_id") + 1, F.lit(top))).first()[0]
            else:
                one = self.spark.createDataFrame([(top + i, *r) for i, r in enumerate(part)], TABLES["entries"])
                top += len(part)
            one = one.select("entry_id", *d.ENTRY)
            out = one if out is None else out.unionByName(one)
        return out


def build(spark: SparkSession, folder: str, exclude: Iterable[str] = ()) -> Lexicon:
    """Builds from a folder of CSV files with matrix.def, char.def and unk.def if there.

    A file that is missing is left out, one that cannot be read or used is an error.
    """
    builder = LexiconBuilder(spark).add_csv_dir(folder, exclude)
    for name, load in (("matrix.def", builder.load_matrix), ("char.def", builder.load_char_def), ("unk.def", builder.load_unk)):
        try:
            load(f"{folder}/{name}")
        except FileNotFoundError:
            if name == "matrix.def":
                warnings.warn(f"{folder}: no matrix.def, all connection costs are 0", stacklevel=2)
    return builder.build()


def merge(spark: SparkSession, base: str, sources: str | list[str], output: str | None = None, reset_char_def: bool = False, exclude: Iterable[str] = ()) -> str:
    """Adds CSV files or folders to a bundle, in this order; returns the path of the new bundle.

    Without ``output`` the new bundle lies beside the old one, which stays readable. With the
    base as output it becomes the next version there. Files of excluded names are left
    out of folders.
    """
    after = latest(spark, base)
    builder = LexiconBuilder(spark).load_lexicon(base, reset_char_def)
    for source in [sources] if isinstance(sources, str) else sources:
        if source.endswith(".csv"):
            builder.add_csv(source)
        else:
            builder.add_csv_dir(source, exclude)
    output = output or f"{base.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    if output.rstrip("/") == base.rstrip("/"):
        if not after:
            raise d.LexiconError(f"{base}: a bundle without versions cannot be merged into itself")
        builder.build().commit(base, after)
    else:
        builder.build().write(output)
    return output


def recipe(spark: SparkSession, folder: str, more: list[str], output: str, exclude: Iterable[str] = ()) -> str:
    """Builds ``folder`` and merges further files and folders in order, without the excluded file names."""
    base = f"{output.rstrip('/')}-base-{uuid.uuid4().hex[:8]}" if more else output
    build(spark, folder, exclude).write(base)
    return merge(spark, base, more, output, exclude=exclude) if more else output


def default_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_CLASSES, schema.CHAR_CLASS)
