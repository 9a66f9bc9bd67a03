"""Intermediate tables that outlive executors: written as Parquet to the shared folder of the cluster and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go once their query is over
BROADCAST_BYTES = 64 << 20  # a side of a join is sent to all executors only up to this size, as counted


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a local folder is made, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed now and read from a table of their own: later steps neither repeat nor depend on the work before.

    So the shuffle files of that work are released as soon as the table stands.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._durable_at = at
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that ``durable`` returned; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._durable_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(field) -> Column:
    """Bytes of a value in memory, or a little more."""
    kind = field.dataType.typeName()
    c = F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 24
    if kind == "array":
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8 + 32
    return F.lit(8).cast("long")


def small_side(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, with a broadcast hint only where its values were counted to take at most so many bytes; joins shuffle otherwise.

    df should be durable, as it is read for the count; its arrays hold numbers.
    """
    size = df.agg(F.sum(sum((_width(f) for f in df.schema.fields), F.lit(32).cast("long"))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most_bytes else df
