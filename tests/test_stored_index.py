"""The stored index against a fresh build, after random changes."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorequarry.operators import lexical, stored_index
from lorequarry.sources import versions

KIND = "id long, text string"


def fresh(spark, live, query):
    """Scores of a new index over the live texts."""
    rows = spark.createDataFrame(list(live.items()), KIND)
    index = lexical.build_index(rows, "id", "text")
    scores = {r.id: round(r.score, 9) for r in lexical.bm25(index, spark.createDataFrame([(query,)], "query string")).collect()}
    return scores, {r.term: r.df for r in index.frequencies.collect()}


def state(index, query):
    return {r.id: round(r.score, 9) for r in stored_index.search(index, query).collect()}, {r.term: r.df for r in index.frequencies().collect()}


def files(index):
    return {s["name"]: sorted(os.listdir(f"{index.folder}/segments/{s['name']}/postings")) for s in index.segments if s["postings"]}


def test_random_changes_equal_a_fresh_build(spark, tmp_path):
    r = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(40)] + ["the", "x"]
    say = lambda: " ".join(r.choice(vocab, r.integers(0, 12))) or None
    live, query = {}, "w1 w2 w2 w3 nowhere"
    index = stored_index.open_index(spark, str(tmp_path / "index"))
    assert state(index, query) == ({}, {})
    for step in range(4):
        gone = [int(i) for i in r.choice(list(live), min(len(live), r.integers(0, 9)), replace=False)] if live else []
        removed = {i: live.pop(i) for i in gone}
        back = gone[: len(gone) // 2]  # replaced in the same change
        added = {i: say() for i in [*back, *range(step * 100, step * 100 + int(r.integers(3, 12)))]}
        live |= added
        index = stored_index.change(index, spark.createDataFrame(list(added.items()), KIND), spark.createDataFrame(list(removed.items()), KIND) if removed else None)
        before = files(index)
        if step % 2:
            index = stored_index.compact(index)
            assert all(before[name] == own for name, own in files(index).items() if name in before)
        assert index.documents == len(live)
        assert state(index, query) == fresh(spark, live, query)
    again = stored_index.open_index(spark, index.folder)
    assert again.segments == index.segments and state(again, query) == state(index, query)
    one = stored_index.compact(again, all_segments=True)
    assert len(one.segments) == 1 and one.segments[0]["tombstones"] == 0 and state(one, query) == state(index, query)
    assert sorted(t.id for t in one.texts().collect()) == sorted(live)
    assert stored_index.clean(one) and sorted(os.listdir(one.folder + "/segments")) == [one.segments[0]["name"]]


def test_refused_changes_leave_the_index(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), KIND)
    index = stored_index.change(stored_index.open_index(spark, str(tmp_path / "i")), rows((1, "alpha"), (2, "beta beta"), (3, None)))
    for add, remove in [(rows((1, "new")), None), (rows((9, "a"), (9, "b")), None), (rows((None, "a")), None), (None, rows((7, "alpha"))), (None, rows((1, "other text")))]:
        with pytest.raises(ValueError):
            stored_index.change(index, add, remove)
    assert stored_index.open_index(spark, index.folder).version == index.version == 1
    assert stored_index.change(index, rows()).version == 1
    late = stored_index.change(index, rows((4, "gamma")))
    with pytest.raises(ValueError):  # another change was first
        stored_index.change(index, rows((5, "delta")))
    assert versions.latest(spark, index.folder)[0] == late.version == 2
    empty = stored_index.change(late, remove=rows((1, "alpha"), (2, "beta beta"), (3, None), (4, "gamma")))
    assert (empty.documents, empty.length, empty.average) == (0, 0, 0.0) and empty.frequencies().count() == 0
    assert stored_index.search(empty, "alpha").count() == 0 and stored_index.search(late, "the of").count() == 0


def test_terms_are_pushed_down_and_row_groups_skipped(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat_ws(" ", F.concat(F.lit("t"), F.col("id")), F.lit("common")).alias("text"))
    index = stored_index.change(stored_index.open_index(spark, str(tmp_path / "i")), rows)
    plan = stored_index.search(index, "t77")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [t77])]" in plan or "EqualTo(term,t77)" in plan
    assert [r.id for r in stored_index.search(index, "t77").collect()] == [77]


def test_blocks_are_counted_in_slices():
    words = [["a", "b"] * (i % 5) for i in range(1000)] + [["c"] * 5000, [], ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words))), pa.array(words, pa.list_(pa.string()))], names=["id", "words"])
    got = list(stored_index._slices(iter([batch.slice(0, 500), batch.slice(500)]), 100))
    assert [x for b in got for x in b.column("id").to_pylist()] == list(range(len(words)))
    assert [x for b in got for x in b.column("words").to_pylist()] == words
    assert all(sum(len(x) for x in b.column("words").to_pylist()) <= 100 or b.num_rows == 1 for b in got)
