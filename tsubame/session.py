"""Session helpers shared by all operators: tables, lineage cuts, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side that may be broadcast after its bytes were summed.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any file system Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session without one gets a temporary folder."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tsubame-ckpt-"))


def _bytes(name: str, kind: T.DataType) -> Column:
    """About what a value of a column takes in memory."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 24
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """``df``, which is materialised, marked for broadcast if its summed bytes are within the bound."""
    size = sum((_bytes(f.name, f.dataType) for f in df.schema), F.lit(16)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def put(spark: SparkSession, path: str, content: bytes, overwrite: bool = True) -> None:
    """A small file in any store that Spark writes; without ``overwrite`` one that is there is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, overwrite)
    out.write(bytearray(content))
    out.close()


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: for small inputs and slow steps."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def arrow_rows(spark: SparkSession, n: int) -> None:
    """Rows per Arrow batch: bounds what a Python worker holds of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again."""
    path = f"{scratch(df.sparkSession)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, by: list[str], into: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the order of ``by``: a range sort, then the counts of its partitions.

    What passes the driver is one count a partition; no task sees all rows.
    """
    at = cut(df.sort(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    sizes, total = [], 0
    for r in at.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("least")).orderBy("_part").collect():
        sizes.append((r["_part"], total - r["least"]))
        total += r["n"]
    shift = df.sparkSession.createDataFrame(sizes, "_part int, _shift long")
    return at.join(F.broadcast(shift), "_part").withColumn(into, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
