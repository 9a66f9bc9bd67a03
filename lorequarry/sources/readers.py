"""Readers and writers: Markdown trees, code trees, nested JSON imports, snapshots replaced by instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.operators.files import normalised_path, readable_files

IMPORT_SCHEMA = "name string, position struct<x:double,y:double,z:double>, size float, ores array<struct<id:string,volume:double,position:struct<x:double,y:double,z:double>,estimated:boolean>>"


def read_tree(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, content) of the files below root, paths relative to it."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    url = F.call_function("url_decode", F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/+", "/"))
    return rows.select(normalised_path(url, root).alias("path"), F.col("value").alias("content"))


def read_code(spark: SparkSession, root: str, most_bytes: int = 5 << 20) -> DataFrame:
    """(path, content) of text files of a code tree, without ignored directories and binary or large files."""
    return readable_files(read_tree(spark, root, "*"), most_bytes)


def read_imports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sites, deposits) of the JSON arrays IMPORT_<instance>.json of a folder; missing names are empty, positions 0."""
    raw = spark.read.schema(IMPORT_SCHEMA).json(folder, multiLine=True, pathGlobFilter="IMPORT_*.json")
    return imported_parts(raw, F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"^IMPORT_(.*)\.json$", 1)))


def imported_parts(raw: DataFrame, instance: Column) -> tuple[DataFrame, DataFrame]:
    """(sites, deposits) of imported records."""
    at = lambda c: [F.coalesce(F.col(f"{c}.{a}"), F.lit(0.0)).alias(a) for a in "xyz"]
    rows = raw.withColumn("instance", instance).withColumn("name", F.coalesce("name", F.lit("")))
    sites = rows.select("instance", "name", *at("position"), "size", F.lit(False).alias("mined"))
    ores = rows.select("instance", "name", F.explode("ores").alias("o")).where("o IS NOT NULL")
    deposits = ores.select("instance", "name", F.lower(F.coalesce("o.id", F.lit(""))).alias("kind"), F.coalesce("o.volume", F.lit(0.0)).alias("volume"), *at("o.position"), F.coalesce("o.estimated", F.lit(False)).alias("estimated"))
    return sites, deposits


def replace_instances(rows: DataFrame, path: str, partition: str = "instance") -> None:
    """Writes rows by partition; partitions that occur in them are replaced, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational store; needs its JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def notification_errors(rows: DataFrame) -> DataFrame:
    """rows (content, title, description, colour) with ``error``: the first limit that a notification breaks, else null."""
    # Limits of the receiving service.
    limits = (("content", 2000), ("title", 256), ("description", 4096))
    error = F.lit(None).cast("string")
    for column, most in reversed(limits):
        error = F.when(F.length(column) > most, F.lit(f"{column} longer than {most}")).otherwise(error)
    return rows.withColumn("error", F.when(~F.col("colour").between(0, 0xFFFFFF), "colour out of range").otherwise(error))
