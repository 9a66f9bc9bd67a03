"""Registered queries over their whole tables, against plain Python on the smallest tables."""

import re

import numpy as np
import pytest

from lorequarry.operators import lexical, vectors
from lorequarry.plans import registry
from lorequarry.session import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").collect()


def run(spark, name):
    return registry.queries()[name](spark, DATA).collect()


def test_batch_knn_asks_all_stated_ids(spark):
    rows = table(spark, DATA, "embeddings").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = {}
    for i in ids[ids % 20 == 0]:
        far = np.round(1.0 - v @ v[ids == i][0], 9)
        want |= {(int(i), n + 1): int(ids[j]) for n, j in enumerate(np.lexsort((ids, far))[:10])}
    assert {(r.query_id, r["rank"]): r.vec_id for r in run(spark, "vc7_batch_knn")} == want
    assert run(spark, "ag18_recall")[0].recall == 1.0


def test_batch_knn_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(50)] + [(50, None), (51, [1.0]), (52, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    got = {tuple(r) for r in vectors.knn_batch(v, q, 3, block_rows=8, batch_queries=2).drop("score").collect()}
    want = {(a, b, n + 1) for a in range(0, 50, 5) for n, (_, b) in enumerate(sorted((1 - (a % 7) * (b % 7) - 1, b) for b in range(50))[:3])}
    assert got == want


def test_recall_counts_what_is_missing(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 3)], "query_id long, vec_id long")
    assert vectors.recall(truth.where("vec_id < 3"), truth).first().recall == 0.75


def test_union_of_sets_reads_all_documents(spark, docs):
    assert {r.v for r in run(spark, "so3_union_of_sets")} == {d.lang for d in docs} | {d.source for d in docs}


def test_enclosing_block_locates_all_documents(spark, docs):
    want = {}
    for source, s in {(d.source, d.doc_id % 90) for d in docs}:
        inside = [(-(n.doc_id % 6), n.doc_id) for n in docs if n.source == source and n.doc_id % 6 * 10 <= s and 120 - n.doc_id % 6 * 10 >= s + 3]
        if inside:
            want[source, s, s + 3] = min(inside)[1]
    assert {(r.doc, r.s, r.e): r.node_id for r in run(spark, "jn10_enclosing_block")} == want


def test_fetch_reads_all_documents(spark, docs):
    content = {d: f"# Doc {d.doc_id}\n\n[def d{d.doc_id}] [dependsOn src1/{d.doc_id + 20}.md]\n\n{d.text}\n\n- one\n- two\n" for d in docs}
    assert sorted(map(tuple, run(spark, "df1_fetch"))) == sorted((f"{d.source}/{d.doc_id}.md:2,60", content[d][2:60]) for d in docs)


def test_bounding_trees_take_all_documents(spark, docs):
    folders = {}
    for d in docs:
        folders.setdefault(d.doc_id // 10 + 1, []).append(d)
    want = {f: (len(own), round(sum(1 / (d.doc_id + 1) for d in own) / len(own), 6), sum(d.n_chars for d in own)) for f, own in folders.items()}
    assert {r.root: (r.hits, r["mean"], r.chars) for r in run(spark, "hy9_bounding_trees")} == want


def test_grep_context_reads_all_files(spark, docs):
    want = set()
    for d in docs:
        hit = [bool(re.search("idiot|moron", x)) for x in re.split("\r\n|\n|\r", d.text)]
        want |= {(f"{d.source}/{d.doc_id}.txt", i + 1, h) for i, h in enumerate(hit) if any(hit[max(0, i - 1) : i + 2])}
    assert {tuple(r) for r in run(spark, "cd2_grep_context")} == want


# --- results without row caps ---


def test_counts_and_distances_have_no_caps(spark):
    for name in ("cd2_grep_inverted", "vc1_distances"):
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "row_number" not in plan and "1000000" not in plan


def test_keyed_bm25_scores_all_queries(spark):
    texts = spark.createDataFrame([(i, f"term{i} shared") for i in range(6)], "id long, text string")
    queries = spark.createDataFrame([(i, f"term{i}") for i in range(6)], "key long, query string")
    index = lexical.build_index(texts, "id", "text")
    few, many = lexical.bm25(index, queries, key="key", small_rows=2), lexical.bm25(index, queries, key="key")
    assert "Limit" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(few.collect()) == sorted(many.collect())
    assert {(r.key, r.id) for r in few.collect()} == {(i, i) for i in range(6)}
