"""Lexicon entries, their trie and the connection costs, in files that workers share by memory mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubame.functions.readings import NUMBER_POS
from tsubame.operators.trie import Levels, Trie, fill, levels, shapes
from tsubame.session import scratch

COLUMNS = ["surface", "entry_id", "left_id", "right_id", "cost", "pos", "base_form", "reading", "pronunciation"]
SCHEMA = pa.schema([(c, pa.string() if i in (0, 5, 6, 7, 8) else pa.int32()) for i, c in enumerate(COLUMNS)])
NUMBERS, STRINGS = COLUMNS[1:5], [COLUMNS[0], *COLUMNS[5:]]
# Entries that a task brings into columns, and that pass the driver, at a time: about so many.
PART_ENTRIES = 100_000


def shared_file(spark: SparkSession, write: Callable[[str], None]) -> str:
    """A file, written by ``write``, in the shared folder: its path, or a name if executors must fetch it from there, once.

    A shared folder that is mounted alike everywhere is mapped where it is.
    """
    name = f"tsubame-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(path.getParent())
        write(path.toUri().getPath())
        return path.toUri().getPath()
    with tempfile.TemporaryDirectory(prefix="tsubame-") as folder:
        local = os.path.join(folder, name)
        write(local)
        fs.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), path)
    spark.sparkContext.addFile(path.toString())
    return name


class Arrays:
    """Named arrays, in memory or one behind the other in a shared file."""

    def __init__(self, arrays: dict[str, np.ndarray] | None, file: str | None = None, layout: dict[str, tuple] | None = None) -> None:
        self.arrays, self.file, self.layout = arrays, file, layout
        if file:
            path = file if os.path.isabs(file) else SparkFiles.get(file)
            self.arrays = {n: np.memmap(path, dtype, "r", at, shape) if np.prod(shape) else np.zeros(shape, dtype) for n, (dtype, shape, at) in layout.items()}

    @staticmethod
    def shared(spark: SparkSession, arrays: dict[str, np.ndarray]) -> Arrays:
        layout: dict[str, tuple] = {}

        def write(path: str) -> None:
            with open(path, "wb") as out:
                for name, a in arrays.items():
                    out.write(bytes(-out.tell() % 64))
                    layout[name] = (a.dtype.str, a.shape, out.tell())
                    np.ascontiguousarray(a).tofile(out)
                    out.flush()

        return Arrays(None, shared_file(spark, write), layout)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def __reduce__(self) -> tuple:
        return Arrays, (None if self.file else self.arrays, self.file, self.layout)


class Growing:
    """Named arrays that grow at their ends, each in a file of its own, so nothing holds one of them whole."""

    def __init__(self, folder: str) -> None:
        self.folder, self.kinds = folder, {}

    def add(self, name: str, values: np.ndarray) -> None:
        self.kinds[name] = values.dtype
        with open(os.path.join(self.folder, name), "ab") as out:
            np.ascontiguousarray(values).tofile(out)

    def make(self, name: str, size: int, kind: type) -> np.ndarray:
        """An array of zeros to be filled."""
        return np.memmap(os.path.join(self.folder, name), kind, "w+", shape=(size,))

    def __getitem__(self, name: str) -> np.ndarray:
        path = os.path.join(self.folder, name)
        return np.memmap(path, self.kinds[name], "r") if os.path.getsize(path) else np.zeros(0, self.kinds[name])


def _columns(table: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    """Columns of entries as arrays: numbers, and of strings their bytes and, in ``name.size``, their sizes."""
    for name in NUMBERS:
        yield name, table.column(name).combine_chunks().to_numpy()
    for name in STRINGS:
        # A base form that is missing is the surface.
        x = pc.coalesce(table.column(name), table.column("surface")) if name == "base_form" else table.column(name)
        x = pc.fill_null(x, "").combine_chunks().cast(pa.large_string())
        at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
        raw = x.buffers()[2]
        yield name, np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
        yield f"{name}.size", np.diff(at).astype(np.int32)


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, data) of a sorted part: its first and last surface, its columns and its levels of the trie."""
    if not (found := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(found)
    surface = table.column("surface").combine_chunks()
    for i in (0, -1):
        yield pa.record_batch([["border"], [surface[i].as_py().encode()]], ["name", "data"])
    for name, values in _columns(table):
        yield pa.record_batch([[name], [values.tobytes()]], ["name", "data"])
    for level in levels(surface):
        yield pa.record_batch([["level"], [level.tobytes()]], ["name", "data"])
    yield pa.record_batch([["rows"], [str(len(table)).encode()]], ["name", "data"])


def _gathered(rows: DataFrame, parts: int, grown: Growing, depths: Levels) -> None:
    """Brings entries in the order of (surface, entry_id) into files; tasks make the parts, the driver holds one at a time."""
    numbers = {n: F.col(n).cast("int") for n in NUMBERS}
    at = rows.select(*COLUMNS).withColumns(numbers).repartitionByRange(parts, "surface").sortWithinPartitions("surface", "entry_id")
    border, found = [], []
    for name in NUMBERS:
        grown.add(name, np.zeros(0, np.int32))
    for name in STRINGS:
        grown.add(name, np.zeros(0, np.uint8))
        grown.add(f"{name}.size", np.zeros(0, np.int32))
    for r in at.mapInArrow(_part, "name string, data binary").toLocalIterator(prefetchPartitions=True):
        name, data = r["name"], bytes(r["data"])
        if name == "border":
            border.append(data.decode())
        elif name == "level":
            found.append(data)
        elif name == "rows":
            depths.add(*border, int(data), found)
            border, found = [], []
        else:
            grown.add(name, np.frombuffer(data, grown.kinds[name]))


def _offsets(grown: Growing, name: str) -> np.ndarray:
    """Where each string begins, with the end: 32 bits if they suffice."""
    size = grown[f"{name}.size"]
    kind = np.int32 if len(grown[name]) < 1 << 31 else np.int64
    out, done = grown.make(f"{name}.at", len(size) + 1, kind), 0
    for i in range(0, len(size), 1 << 20):
        part = np.cumsum(size[i : i + (1 << 20)], dtype=np.int64) + done
        out[i + 1 : i + 1 + len(part)], done = part, int(part[-1])
    return out


class Entries:
    """Rows in the order of (surface, entry_id), searched by common prefix from many places at once."""

    def __init__(self, arrays: Arrays) -> None:
        self.arrays = arrays
        self.trie = Trie(arrays)
        self.ids, self.left, self.right, self.cost = (arrays[c] for c in NUMBERS)
        self.surfaces, *self.features = (self._strings(c) for c in STRINGS)
        self._numeric: np.ndarray | None = None

    def _strings(self, name: str) -> pa.Array:
        """A column of strings over the mapped bytes, not a copy."""
        at, raw = self.arrays[f"{name}.at"], self.arrays[name]
        kind = pa.StringArray if at.dtype == np.int32 else pa.LargeStringArray
        return kind.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw))

    @staticmethod
    def of(rows: list[tuple]) -> Entries:
        """(surface, left_id, right_id, cost, pos, base_form, reading, pronunciation) rows."""
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0].encode(), i))
        table = pa.Table.from_arrays([pa.array([(rows[i][0], i, *rows[i][1:])[c] for i in order], f.type) for c, f in enumerate(SCHEMA)], schema=SCHEMA)
        out = dict(_columns(table))
        for name in STRINGS:
            out[f"{name}.at"] = np.cumsum(np.append(0, out.pop(f"{name}.size"))).astype(np.int32)
        return Entries(Arrays(out | Trie.of(table.column("surface").combine_chunks()).arrays))

    @staticmethod
    def shared(spark: SparkSession, rows: DataFrame, n: int) -> Entries:
        """The ``n`` entries and their trie in a file that executors map."""
        with tempfile.TemporaryDirectory(prefix="tsubame-") as folder:
            grown, depths = Growing(folder), Levels(folder)
            _gathered(rows, -(-n // PART_ENTRIES) or 1, grown, depths)
            out = {name: grown[name] for name in (*NUMBERS, *STRINGS)}
            out |= {f"{name}.at": _offsets(grown, name) for name in STRINGS}
            made = depths.all()
            trie = {name: grown.make(name, *x) for name, x in shapes(sum(map(len, made))).items()}
            fill(trie, made)
            return Entries(Arrays.shared(spark, out | trie))

    def __reduce__(self) -> tuple:
        return Entries, (self.arrays,)

    def __len__(self) -> int:
        return len(self.ids)

    def surface(self, row: int) -> str:
        return self.surfaces[row].as_py()

    def feature(self, i: int, rows: pa.Array) -> pa.Array:
        """Part of speech, base form, reading or pronunciation of these rows; null for null."""
        return self.features[i].take(rows).cast(pa.string())

    @property
    def numeric(self) -> np.ndarray:
        """Whether each entry is a number by its part of speech."""
        if self._numeric is None:
            self._numeric = pc.starts_with(self.features[0], NUMBER_POS).to_numpy(zero_copy_only=False) if len(self) else np.zeros(0, bool)
        return self._numeric
