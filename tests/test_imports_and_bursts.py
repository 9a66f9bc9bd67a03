"""Import outcomes over crashes, and bursts against the fold."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorequarry.sources import imports, versions
from lorequarry.streaming import bursts, events


def drop(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def site(name, *ores):
    return {"name": name, "position": {"x": 1.0, "y": 2.0, "z": 3.0}, "size": 4.0, "ores": [{"id": o, "volume": 5.0} for o in ores]}


def state(spark, target):
    read = lambda kind: sorted(tuple(r) for r in spark.read.schema("name string, instance string").parquet(f"{target}/{kind}").select("instance", "name").collect())
    return read("sites"), read("deposits")


def start(tmp_path):
    folder = tmp_path / "in"
    drop(folder, "IMPORT_Alpha.json", [site("a1", "Iron", "Gold"), site("a2")])
    drop(folder, "IMPORT_beta.json", '[{"name": "b1", "position": ')
    drop(folder, "IMPORT_gamma.json", [site("g1", "Ice")])
    drop(folder, "FAILED_beta.json", "older")
    drop(folder, "other.json", "[]")
    return folder, [str(x) for x in (folder, tmp_path / "store", tmp_path / "log")]


WANT = ([("alpha", "a1"), ("alpha", "a2"), ("gamma", "g1")], [("alpha", "a1"), ("alpha", "a1"), ("gamma", "g1")])
LEFT = ["FAILED_beta.json", "other.json"]


def test_files_are_loaded_deleted_or_renamed(spark, tmp_path):
    folder, at = start(tmp_path)
    assert imports.import_folder(spark, *at) == {"IMPORT_Alpha.json": "loaded", "IMPORT_beta.json": "failed", "IMPORT_gamma.json": "loaded"}
    assert sorted(n for n in os.listdir(folder) if not n.startswith(".")) == LEFT and "b1" in (folder / "FAILED_beta.json").read_text()
    assert state(spark, at[1]) == WANT and imports.import_folder(spark, *at) == {}
    drop(folder, "IMPORT_ALPHA.json", [site("new")])  # replaces the instance
    drop(folder, "IMPORT_alpha.json", [])  # the last name counts: empty
    drop(folder, "IMPORT_gamma.json", [site("g2")])
    assert set(imports.import_folder(spark, *at).values()) == {"loaded"}
    assert state(spark, at[1]) == ([("gamma", "g2")], [])


@pytest.mark.parametrize("step", ["publish", "finish"])
def test_a_crash_between_the_steps_doubles_nothing(spark, tmp_path, monkeypatch, step):
    folder, at = start(tmp_path)
    where = versions if step == "publish" else imports

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(where, step, crash)
        for _ in range(2):  # twice
            with pytest.raises(KeyboardInterrupt):
                imports.import_folder(spark, *at)
    assert state(spark, at[1]) == WANT and (folder / "IMPORT_gamma.json").exists()
    if step == "finish":  # marked files are not read again, even if they could not be
        os.chmod(folder / "IMPORT_gamma.json", 0o644)
    assert len(imports.import_folder(spark, *at)) == 3
    assert state(spark, at[1]) == WANT and sorted(n for n in os.listdir(folder) if not n.startswith(".")) == LEFT


def test_a_marked_name_with_new_content_is_loaded(spark, tmp_path):
    folder, at = start(tmp_path)
    imports.import_folder(spark, *at)
    drop(folder, "IMPORT_beta.json", [site("b2")])
    assert imports.import_folder(spark, *at) == {"IMPORT_beta.json": "loaded"}
    assert ("beta", "b2") in state(spark, at[1])[0]


@pytest.mark.parametrize("spread", [200, 2_000, 200_000])
def test_bursts_equal_the_fold(spark, spread):
    r = np.random.default_rng(spread)
    n = 900
    keys = np.where(r.random(n) < 0.4, 0, r.integers(0, 6, n))  # one key has many of the events
    at = pd.to_datetime(r.integers(0, spread * 1000, n) // 100 * 100, unit="us")
    rows = spark.createDataFrame(pd.DataFrame({"key": keys, "ts": at})).repartition(5)
    for millis in (20, 600):
        want = sorted((x.key, x.ts, x.n) for x in events.debounced(rows, millis).collect())
        assert sorted((x.key, x.ts, x.n) for x in bursts.debounced(rows, millis).collect()) == want


def test_a_hot_key_is_the_work_of_many_tasks(spark):
    one = spark.range(3000).select(F.lit(1).cast("long").alias("key"), F.timestamp_millis(F.col("id") * 7).alias("ts"))
    parts = bursts._events_of(one, 20_000).repartition(8, "key", "b").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) == 8
    got = bursts.debounced(one, 20).collect()
    assert sum(g.n for g in got) == 3000 and {g.n for g in got} == {3}
    odd = spark.createDataFrame([(None, None), (1, None)], "key long, ts timestamp")
    assert bursts.debounced(odd, 20).count() == 0
