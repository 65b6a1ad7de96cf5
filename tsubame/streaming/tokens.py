"""Tokenisation of a stream of lines: stateless, the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tsubame.operators.analyzer import Analyzer
from tsubame.sources.text import lines


def line_stream(analyzer: Analyzer, folder: str) -> DataFrame:
    """Streaming DataFrame (text, tokens) of the lines of files that appear in a folder."""
    return analyzer.tokenize_batch(lines(analyzer.spark.readStream.text(folder)))


def run_available(df: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there into parquet, each input once, and stops."""
    return df.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
