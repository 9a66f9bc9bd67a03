"""Values by rank, medians and numbers in order, against plain Python."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.operators import relational, selection


@pytest.mark.parametrize("case", ["spread", "ties", "two values", "one value", "heavy tail"])
@pytest.mark.parametrize("n", [20_000, 20_001])
def test_median_with_small_last_buckets(spark, case, n):
    r = np.random.default_rng(n)
    x = {
        "spread": r.normal(size=n),
        "ties": r.integers(0, 7, n).astype(float),
        "two values": np.where(np.arange(n) < n // 2, 1.0, 2.0),
        "one value": np.full(n, 3.5),
        "heavy tail": np.exp(r.normal(size=n) * 20),
    }[case]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x double").repartition(4)
    middle = statistics.median(x.tolist())
    assert selection.exact_median(rows, "x", most_rows=50) == middle
    if case in ("ties", "two values"):
        got = selection.median_and_mad(rows, "x", most_rows=50).first()
        assert (got.median, got.mad) == (middle, statistics.median(np.abs(x - middle).tolist()))


def test_ranks_and_nothing(spark):
    v = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert [selection.value_at(v, r, most_rows=10) for r in (1, 2, 500, 999, 1000)] == [0.0, 1.0, 499.0, 998.0, 999.0]
    assert selection.value_at(v, 1001) is None and selection.value_at(v, 0) is None
    empty = spark.createDataFrame([(None,)], "x double")
    assert selection.exact_median(empty, "x") is None and tuple(selection.median_and_mad(empty, "x").first()) == (None, None)


def test_no_task_holds_more_than_its_range(spark):
    rows = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("name")).repartition(7)
    got = selection.numbered(rows, "name").collect()
    want = {x: i + 1 for i, x in enumerate(sorted(r.name for r in rows.collect()))}
    assert {r["name"]: r.n for r in got} == want
    plan = selection.numbered(rows, "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(name" not in plan  # only the counts of ranges are ordered in one place


def test_ids_for_names(spark):
    known = spark.createDataFrame([(7, "b")], "id long, name string")
    names = spark.createDataFrame([("c",), ("a",), ("b",), ("c",), (None,)], "name string")
    assert {(r.id, r.name) for r in relational.ids_for(names, known).collect()} == {(7, "b"), (8, "a"), (9, "c")}
    assert {(r.id, r.name) for r in relational.ids_for(names.where("name = 'a'"), known.where("id < 0")).collect()} == {(1, "a")}
