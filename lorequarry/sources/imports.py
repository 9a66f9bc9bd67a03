"""Imports of JSON files with an outcome for each file that survives a crash at any step.

A run takes the files IMPORT_<instance>.json of a folder.  It loads those that parse, replacing their instances, then marks the outcome of every
file (with its size and time) in a versioned log, and only then deletes the files that were loaded and renames the others to FAILED_<instance>.json.
A run that broke off before the mark is done again, and replaces the same instances; one that broke off after it only deletes and renames.

Defined cases: of several files for one instance the last name counts; an empty array empties its instance; a single object counts as an
array of it; a FAILED_ file of that name is replaced; a folder without such files does nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorequarry.session import cut
from lorequarry.sources import versions
from lorequarry.sources.readers import IMPORT_SCHEMA, imported_parts, replace_instances

PREFIX, FAILED = "IMPORT_", "FAILED_"


def waiting(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Name -> size and time of the files that wait for import; their number is that of a folder."""
    path, files = versions._files(spark, folder)
    if not files.exists(path):
        return {}
    found = {s.getPath().getName(): {"size": s.getLen(), "time": s.getModificationTime()} for s in files.listStatus(path) if s.isFile()}
    return {n: own for n, own in sorted(found.items()) if re.fullmatch(rf"{PREFIX}.*\.json", n)}


def instance_of(name: str) -> str:
    return name[len(PREFIX) : -len(".json")].lower()


def finish(spark: SparkSession, folder: str, name: str, outcome: str) -> None:
    """Deletes a loaded file, and renames a failed one."""
    at, files = versions._files(spark, f"{folder}/{name}")
    if outcome == "loaded":
        files.delete(at, False)
    else:
        to = versions._files(spark, f"{folder}/{FAILED}{name[len(PREFIX):]}")[0]
        files.delete(to, False)
        files.rename(at, to)


def import_folder(spark: SparkSession, folder: str, target: str, log: str) -> dict[str, str]:
    """Name -> outcome (loaded or failed) of the files of a run; rows go to target/sites and target/deposits by instance."""
    number, marked = versions.latest(spark, log) or (0, {"files": {}})
    files = waiting(spark, folder)
    outcomes = {}
    for name, own in files.items():  # an earlier run broke off behind its mark
        known = marked["files"].get(name)
        if known and {k: known[k] for k in own} == own:
            outcomes[name] = known["outcome"]
    todo = [n for n in files if n not in outcomes]
    if todo:
        raw = spark.read.schema(IMPORT_SCHEMA + ", __corrupt string").option("columnNameOfCorruptRecord", "__corrupt").json([f"{folder}/{n}" for n in todo], multiLine=True)
        raw = cut(raw.withColumn("__file", F.element_at(F.split(F.call_function("url_decode", F.col("_metadata.file_path")), "/"), -1)))  # each file is read once
        bad = {r[0] for r in raw.select("__file", "__corrupt").where("__corrupt is not null").select("__file").distinct().collect()}  # some of the folder's files
        good = {instance_of(n): n for n in todo if n not in bad}  # of one instance the last name
        if good:
            rows = raw.where(F.col("__file").isin(list(good.values()))).drop("__corrupt")
            for kind, part in zip(("sites", "deposits"), imported_parts(rows, F.lower(F.regexp_extract("__file", rf"^{PREFIX}(.*)\.json$", 1))), strict=True):
                replace_instances(part, f"{target}/{kind}")
                filled = {r[0] for r in part.select("instance").distinct().collect()}  # instances of this run
                for instance in good.keys() - filled:
                    at, fs = versions._files(spark, f"{target}/{kind}/instance={instance}")
                    fs.delete(at, True)
        new = {n: "failed" if n in bad else "loaded" for n in todo}
        keep = {n: own for n, own in marked["files"].items() if n in files and n not in new}
        versions.publish(spark, log, number + 1, {"files": keep | {n: files[n] | {"outcome": o} for n, o in new.items()}})
        outcomes |= new
    for name, outcome in outcomes.items():
        finish(spark, folder, name, outcome)
    return outcomes
