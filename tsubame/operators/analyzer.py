"""Tokenisation of DataFrames: columns, rows, renderings, SQL functions."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tsubame import schema
from tsubame.functions.render import render
from tsubame.operators.entries import Arrays, Entries
from tsubame.operators.kernel import Kernel, pieces, unknown_templates
from tsubame.sources.lexicon import Lexicon, LexiconBuilder

FIELDS = ["surface", "start", "end", "pos", "base_form", "reading", "pronunciation", "word_cost", "is_known"]


# Rows of entries that may pass the driver: a hundred times the largest known lexicon's million.
MOST_ENTRIES = 100_000_000


def kernel_of(lexicon: Lexicon, unk_defaults: str = "by_class") -> Kernel:
    """Gathers a lexicon for decoding: entries, trie and costs as files that executors map.

    Tasks make the columns and the trie of a part of the entries each; parts pass the driver one
    by one on their way into the file, costs row by row.
    """
    n = lexicon.entries.count()
    if n > MOST_ENTRIES:
        raise ValueError(f"{n} entries are more than {MOST_ENTRIES}, which one file can serve")
    entries = Entries.shared(lexicon.spark, lexicon.entries, n)
    costs = Arrays.shared(lexicon.spark, {"matrix": dense(lexicon)})
    unk = [tuple(r) for r in lexicon.unk.orderBy("ord").select("class", "left_id", "right_id", "cost", "pos").collect()]
    classifier = lexicon.classifier()
    return Kernel(entries, None, classifier, unknown_templates(classifier, unk, unk_defaults), costs)


def dense(lexicon: Lexicon) -> np.ndarray:
    """The costs as one array in a temporary file; tasks make its rows, the driver holds one at a time.

    Rows are right ids; the flat layout has as many cells as the header says.
    """
    right, left = lexicon.matrix.agg(F.max("right_id"), F.max("left_id")).first()
    shape = (max(lexicon.right_size, (right or 0) + 1), max(lexicon.left_size, (left or 0) + 1))

    def row(key: tuple, cells: pa.Table) -> pa.Table:
        out = np.zeros(shape[1], np.int16)
        out[cells.column("left_id").to_numpy()] = cells.column("cost").to_numpy()
        return pa.table({"right_id": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([out.tobytes()], pa.binary())})

    matrix = np.memmap(tempfile.TemporaryFile(prefix="tsubame-"), np.int16, "w+", shape=shape)
    for r in lexicon.matrix.groupBy("right_id").applyInArrow(row, "right_id int, row binary").toLocalIterator():
        matrix[r["right_id"]] = np.frombuffer(r["row"], np.int16)
    return matrix


class Analyzer:
    """Tokenises columns of text with one lexicon, which is broadcast once."""

    def __init__(self, lexicon: Lexicon | str, spark: SparkSession | None = None, unk_defaults: str = "by_class") -> None:
        if isinstance(lexicon, str):
            lexicon = Lexicon.read(spark or SparkSession.active(), lexicon)
        self.spark, self.lexicon = lexicon.spark, lexicon
        self.kernel = kernel_of(lexicon, unk_defaults)
        self._shared = self.spark.sparkContext.broadcast(self.kernel)

    def prewarm(self) -> Analyzer:
        """Loads the lexicon on the driver and, in one barrier stage over all slots, in the workers of every executor.

        With fewer free slots than the session has cores the stage fails, as barriers do;
        executors then load with their first batch.
        """
        self.kernel.tokens("")
        self.warm_workers()
        return self

    def warm_workers(self) -> list[Row]:
        """(worker, entries) of each slot: the process that holds the lexicon now, and its size."""
        shared, slots = self._shared, self.spark.sparkContext.defaultParallelism

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel = shared.value
            kernel.tokens("")
            for b in batches:
                yield pa.record_batch([pa.array([f"{os.uname().nodename}:{os.getpid()}"] * b.num_rows), pa.array([len(kernel.entries)] * b.num_rows, pa.int64())], ["worker", "entries"])

        return self.spark.range(0, slots, 1, slots).mapInArrow(load, "worker string, entries long", barrier=True).collect()

    def clone_for_worker(self) -> Analyzer:
        """Analyzers hold no state of a call, so one serves all threads."""
        return self

    def tokenize_udf(self):  # noqa: ANN201
        """Arrow UDF from text to an array of tokens; what it returns at a time is bounded by text, not by rows."""
        shared = self._shared

        @F.arrow_udf(schema.TOKENS)
        def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield from map(shared.value.token_array, pieces(texts))

        return tokens

    def tokens(self, text: Column | str = "text") -> Column:
        return self.tokenize_udf()(text)

    def tokenize_batch(self, df: DataFrame, text: str = "text", into: str = "tokens") -> DataFrame:
        """``df`` with its tokens as an array; empty text gives an empty one."""
        return df.withColumn(into, self.tokens(F.col(text)))

    def totals(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with n_tokens, n_known and word_costs of its texts: decoded as by ``tokens``, but no token leaves the worker."""
        shared = self._shared

        @F.arrow_udf("struct<n_tokens:int,n_known:int,word_costs:bigint>")
        def total(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield from map(shared.value.total_array, pieces(texts))

        return df.withColumn("_total", total(F.col(text))).select(*df.columns, "_total.*")

    def prefixes_udf(self):  # noqa: ANN201
        """Arrow UDF from text to an array of the entries at all its characters, bounded alike."""
        shared = self._shared

        @F.arrow_udf("array<struct<start:int,length:int,entry_id:int>>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield from map(shared.value.prefix_array, pieces(texts))

        return found

    def prefixes(self, df: DataFrame, text: str = "text", into: str = "prefixes") -> DataFrame:
        """``df`` with all entries that begin at each character: an array of (start, length, entry_id), in that order."""
        return df.withColumn(into, self.prefixes_udf()(F.col(text)))

    def tokenize(self, df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
        """One row a token: keys, tok_idx and the token's fields."""
        keys = [c for c in df.columns if c != text] if keys is None else keys
        flat = df.select(*keys, F.posexplode(self.tokens(F.col(text))).alias("tok_idx", "t"))
        return flat.select(*keys, "tok_idx", "t.*")

    def rendered(self, df: DataFrame, text: str = "text", fmt: str = "mecab", into: str = "output") -> DataFrame:
        df = self.tokenize_batch(df, text, "_tokens")
        return df.withColumn(into, render(F.col("_tokens"), fmt)).drop("_tokens")

    def to_mecab(self, df: DataFrame, text: str = "text", into: str = "output") -> DataFrame:
        return self.rendered(df, text, "mecab", into)

    def wakachi(self, df: DataFrame, text: str = "text", into: str = "output") -> DataFrame:
        return self.rendered(df, text, "wakachi", into)

    def tokens_of(self, text: str) -> list[Row]:
        """Tokens of one text, on the driver."""
        return [Row(*FIELDS)(*t) for t in self.kernel.tokens(text)]

    def register(self, scalar: str = "tokenize", table: str = "tokens") -> None:
        """SQL functions: ``tokenize(text)``, and ``tokens(text)`` for LATERAL."""
        self.spark.udf.register(scalar, self.tokenize_udf())
        columns = "tok_idx int, " + schema.TOKEN[7:-1].replace(":", " ").replace(",", ", ").replace(" end ", " `end` ")
        fields = ", ".join(f"t.`{c}`" for c in FIELDS)
        # A table function in SQL over the Arrow function: lateral joins admit no Arrow table function.
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {table}(text STRING) RETURNS TABLE ({columns}) RETURN SELECT i, {fields} FROM posexplode({scalar}(text)) AS e(i, t)")


def in_memory(spark: SparkSession, entries: list[tuple] = (), matrix: tuple | None = None, unk: list[tuple] = (), classifier=None) -> Lexicon:  # noqa: ANN001
    """A lexicon from rows; see ``LexiconBuilder``."""
    b = LexiconBuilder(spark).add_entries(entries).add_unk(unk)
    if matrix:
        b.set_matrix(*matrix)
    if classifier:
        b.set_classifier(classifier)
    return b.build()
