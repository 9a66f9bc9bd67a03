"""Persisted vector cells: recall, pruning, changes, odd vectors."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.operators import cells, vectors
from lorequarry.plans import registry

DATA = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<double>"


def clustered(n, groups, dims=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(groups, dims))[r.integers(0, groups, n)] + 0.15 * r.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def x():
    return clustered(3000, 40)


@pytest.fixture(scope="module")
def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND).repartition(4)


def asked(table):
    return table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_recall_and_files_read(spark, table, x, tmp_path):
    index = cells.build(spark, str(tmp_path / "c"), table)
    probes = index.probes_for(cells.RECALL)
    assert len(index.centres) == 55 and probes <= 12  # grouped vectors need few cells
    found = cells.search_batch(index, asked(table), 10, block_rows=40, batch_queries=16)
    assert vectors.recall(found, vectors.knn_batch(table, asked(table), 10)).first().recall >= 0.95
    everything = {(r.query_id, r["rank"]): r.vec_id for r in cells.search_batch(index, asked(table), 10, probes=55).collect()}
    assert everything == {(r.query_id, r["rank"]): r.vec_id for r in vectors.knn_batch(table, asked(table), 10).collect()}
    one = cells.search(index, x[7].tolist(), 5)
    wanted = cells.probed(index, x[7].tolist(), probes)
    scan = index.rows(wanted)
    leaf = scan._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(cell" in leaf.toString() or "PartitionFilters: [cell" in leaf.toString()
    while leaf.children().size():
        leaf = leaf.children().apply(leaf.children().size() - 1)
    scan._jdf.queryExecution().toRdd().count()
    files = leaf.metrics().apply("numFiles").value()
    assert 0 < files < len(index.rows().inputFiles()) / 2 and {r.cell for r in scan.select("cell").distinct().collect()} <= set(wanted)
    assert [r.vec_id for r in one.collect()][0] == 7 and [r.score for r in one.collect()] == sorted(r.score for r in one.collect())


def test_changes_and_versions(spark, table, x, tmp_path):
    index = cells.build(spark, str(tmp_path / "c"), table.where("vec_id < 2000"))
    before = {p["name"] for p in index.parts}
    index = cells.change(index, add=table.where("vec_id >= 2000"), remove=table.where("vec_id % 7 = 0"))
    live = table.where("vec_id % 7 <> 0 or vec_id >= 2000")
    n = len(index.centres)
    near = lambda i: [(r.vec_id, r["rank"]) for r in cells.search(i, x[14].tolist(), 10, probes=n).orderBy("rank").collect()]
    want = [(r.vec_id, r["rank"]) for r in vectors.knn(live, x[14].tolist(), 10).orderBy("rank").collect()]
    assert near(index) == want and before < {p["name"] for p in index.parts}
    again = cells.open_cells(spark, index.folder)
    assert again.version == 2 and np.array_equal(again.centres, index.centres) and again.curve == index.curve and near(again) == want
    back = cells.change(again, add=table.where("vec_id = 14"))
    assert near(back)[0] == (14, 1)
    rebuilt = cells.build(spark, index.folder, live)
    assert rebuilt.version == 4 and rebuilt.rows().count() == live.count()


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (8, [None, 1.0])]
    index = cells.build(spark, str(tmp_path / "c"), spark.createDataFrame(rows, KIND))
    assert sorted(r.vec_id for r in index.rows().collect()) == [1, 6, 7]
    assert [r.vec_id for r in cells.search(index, [1.0, 0.0], 3, probes=9).orderBy("rank").collect()] == [1, 7, 6]
    assert cells.search(index, [1.0], 3).count() == 0
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, q array<double>")
    assert {r.query_id for r in cells.search_batch(index, q, 2, probes=9).collect()} == {1}
    none = cells.build(spark, str(tmp_path / "e"), spark.createDataFrame([], KIND))
    assert cells.search(none, [1.0], 3).count() == 0 and cells.search_batch(none, q, 2).count() == 0 and none.rows().count() == 0
    with pytest.raises(ValueError):
        cells.open_cells(spark, str(tmp_path / "nothing"))


def test_a_large_cell_is_written_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "FILE_ROWS", 100)
    same = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join pieces as small as these
    try:
        index = cells.build(spark, str(tmp_path / "c"), same, cells=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(index.rows().inputFiles()) > 3 and index.sizes() == {0: 1000}


def test_registered_recall(spark):
    assert registry.queries()["vc4_cell_recall"](spark, DATA).first().recall >= 0.95


def test_truth_by_pairs_in_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(r.normal(size=4), 1)]) for i in range(60)] + [(60 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(9)]
    rows += [(70, None), (71, [1.0, None, 0.0, 0.0]), (72, [1.0, 2.0]), (73, [float("nan")] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 6 = 0 or vec_id > 70").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = set()
    for i, q in rows:
        if (i % 6 == 0 or i > 70) and q and None not in q:
            far = sorted((float("inf") if s != s else round(s, 9), j, s) for j, v in rows if v and None not in v and len(v) == len(q) for s in [1 - sum(a * b for a, b in zip(q, v, strict=True))])
            want |= {(i, j, n + 1) for n, (_, j, _) in enumerate(far[:5])}
    found = vectors.knn_by_pairs(table, queries, 5, block_rows=8, batch_queries=3)
    assert {(x.query_id, x.vec_id, x["rank"]) for x in found.collect()} == want
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # pairs meet as blocks, not as rows


def test_placing_holds_few_rows_and_cosines(spark, x, table):
    """Queries of many cells leave a task in small lots, and few cosines are held at once."""
    centres = x[:1500]
    tracemalloc.start()
    one, best = cells.nearest_centres(np.tile(x, (2, 1)), centres, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.tile(x, (2, 1)) @ centres.T
    assert np.array_equal(one[:, 0], scores.argmax(1)) and np.allclose(best[:, 0], scores.max(1))
    assert peak < 16 << 20
    placed = cells._placed(table.coalesce(1), "vec_id", "embedding", x[:40], 30)
    sizes = placed.mapInArrow(lambda batches: (b.select(["cell"]).slice(0, 1) for b in batches), "cell int").count()
    assert sizes >= 3000 * 30 // cells.PLACED_ROWS
    assert placed.count() == 3000 * 30 and placed.distinct().count() == 3000 * 30


def test_results_are_handed_on_in_lots(spark, table, tmp_path, monkeypatch):
    index = cells.build(spark, str(tmp_path / "c"), table)
    want = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cells.search_batch(index, asked(table), 10, block_rows=40, batch_queries=16).collect()}
    monkeypatch.setattr(vectors, "KEPT_ROWS", 200)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cells.search_batch(index, asked(table), 10, block_rows=40, batch_queries=16).collect()} == want
