"""Text sources: a literal, and lines of files or of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unicode white space, as a trim of a line removes it.
_WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_WS}+|{_WS}+$", "")


def literal(spark: SparkSession, text: str) -> DataFrame:
    """The argument as it is, not trimmed."""
    return spark.createDataFrame([(text,)], "text string")


def lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed lines that are not empty, of a batch or streaming text source."""
    return df.select(trimmed(F.col(value)).alias("text")).where("text <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark.read.text(path))
