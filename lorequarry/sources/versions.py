"""Versioned tables of files: immutable parts in a folder, and numbered manifests that name the parts that count.

A change writes its parts first and then one manifest with the next number, which must not exist yet.  Readers see whole versions
only; parts of a change that failed are named by no manifest.  Of two changes at once the second one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """Number and content of the newest manifest; None where there is none."""
    path, files = _files(spark, f"{folder}/manifests")
    if not files.exists(path):
        return None
    numbers = [int(s.getPath().getName()[:-5]) for s in files.listStatus(path) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith((".", "_"))]
    if not numbers:
        return None
    number = max(numbers)
    raw = spark._jvm.org.apache.commons.io.IOUtils.toString(files.open(_files(spark, f"{folder}/manifests/{number:010d}.json")[0]), "UTF-8")
    return number, json.loads(raw)


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Writes the manifest of that number; raises ValueError where another writer was first.

    The content is written aside and renamed, so no reader meets half of it; renaming never replaces a file.
    """
    target, files = _files(spark, f"{folder}/manifests/{number:010d}.json")
    aside = _files(spark, f"{folder}/manifests/.{number:010d}-{spark.sparkContext.applicationId}-{id(content):x}")[0]
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, False)
        raise ValueError(f"version {number} was written by another change")


def drop_unnamed(spark: SparkSession, folder: str, parts: str, named: set[str]) -> list[str]:
    """Deletes the parts that the given names leave out, once no reader of older versions is left; gives their names."""
    path, files = _files(spark, f"{folder}/{parts}")
    gone = [s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName() not in named] if files.exists(path) else []
    for name in gone:
        files.delete(_files(spark, f"{folder}/{parts}/{name}")[0], True)
    return sorted(gone)
