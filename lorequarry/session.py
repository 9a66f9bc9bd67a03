"""Session factory and table loading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", app: str = "lorequarry", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; conf overrides (underscores stand for dots)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Every table of the folder as a temporary view of the same name."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder is made, in local mode only."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, checkpointed to the shared folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, computed now and read from a compressed table in the shared folder, by the columns that are needed."""
    at = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application (as --py-files would)."""
    context = spark.sparkContext
    if not getattr(context, "_lorequarry_shipped", False):
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="spark-package-")) / "lorequarry_package.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        context.addPyFile(str(at))
        context._lorequarry_shipped = True
