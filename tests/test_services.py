"""Embedding, gating and reranking services: batches, retries, quarantine, upserts, restarts."""

import os

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import services as S
from lorequarry.plans.service_queries import LETTERS, letters, share_of_e

KIND = "hash string, text string"
DIMS = len(LETTERS) + 1


def logged(at, fail=lambda texts: None):
    """A factory of services that write down the texts of each call in a folder and may fail."""

    def factory():
        def service(texts):
            with open(f"{at}/{os.getpid()}", "a", encoding="utf-8") as f:
                f.write("|".join(texts) + "\n")
            fail(texts)
            return letters()(texts)

        return service

    return factory


def calls(at):
    out = []
    for name in os.listdir(at):
        with open(f"{at}/{name}", encoding="utf-8") as f:
            out += [line[:-1].split("|") for line in f]
    return out


def rows(spark, texts):
    return spark.createDataFrame([(f"h{t}", t) for t in texts], KIND)


def test_batches_retries_and_rows_at_fault(spark, tmp_path):
    at = str(tmp_path)

    def fail(texts):
        if any("bad" in t for t in texts):
            raise OSError("no answer")

    texts = [f"text {i}" for i in range(200)] + ["bad one", None]
    got = S.embedded(rows(spark, texts).coalesce(1), "text", logged(at, fail), DIMS, attempts=2, wait=0).collect()
    assert len(got) == 202 and [g.error for g in got if g.error] == ["OSError: no answer"]
    assert {g.text for g in got if g.embedding is None} == {"bad one", None}
    assert all(abs(sum(x * x for x in g.embedding) - 1) < 1e-12 for g in got if g.embedding)
    sizes = [len(c) for c in calls(at)]
    assert max(sizes) == 64 and sizes.count(64) == 3 and len(sizes) < 3 + 2 * 8 + 8


@pytest.mark.parametrize("answer", [lambda t: [[1.0] * DIMS] * (len(t) + 1), lambda t: [[1.0]] * len(t), lambda t: [[float("nan")] * DIMS] * len(t), lambda t: None])
def test_answers_that_do_not_fit_are_refused(spark, answer):
    got = S.embedded(rows(spark, ["a", "b"]), "text", lambda: answer, DIMS, attempts=1).collect()
    assert all(g.error and g.embedding is None for g in got)


def test_passing_failure_is_tried_again(spark):
    def factory():
        turns = []

        def service(texts):
            turns.append(1)
            if len(turns) % 2:
                raise TimeoutError
            return share_of_e()(texts)

        return service

    got = S.answered(rows(spark, ["eee", "xe"]).coalesce(1), "text", factory, "double", S.checked_scores, wait=0).collect()
    assert sorted(g.answer for g in got) == [0.5, 1.0]


def test_sync_embeds_only_what_changed(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    factory = logged(str(log))
    store = S.sync_embeddings(S.open_store(spark, str(tmp_path / "s")), rows(spark, ["a", "b", "c", "c"]), factory, DIMS)
    assert sorted(t for c in calls(log) for t in c) == ["a", "b", "c"]
    store = S.sync_embeddings(store, rows(spark, ["b", "c", "d"]), factory, DIMS)
    assert sorted(t for c in calls(log) for t in c) == ["a", "b", "c", "d"]
    assert sorted(r.hash for r in store.vectors().collect()) == ["hb", "hc", "hd"]
    version = store.version
    assert S.sync_embeddings(store, rows(spark, ["b", "c", "d"]), factory, DIMS).version == version  # nothing to do
    store = S.sync_embeddings(store, rows(spark, ["a", "d"]), factory, DIMS)  # a comes back
    assert sorted(r.hash for r in S.open_store(spark, store.folder).vectors().collect()) == ["ha", "hd"]


def test_restart_neither_doubles_nor_loses_rows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    texts = [f"t{i}" for i in range(40)]
    switch = tmp_path / "broken"
    switch.write_text("")
    whole, marks = logged(str(log)), (str(switch), str(log))

    def broken():
        def service(batch):
            if os.path.exists(marks[0]) and os.listdir(marks[1]):
                os._exit(1)  # the worker dies in a later wave
            return whole()(batch)

        return service

    store = S.open_store(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match=".*"):
        S.sync_embeddings(store, rows(spark, texts).coalesce(1), broken, DIMS, waves=4)
    first = S.open_store(spark, store.folder)
    done = {r.hash for r in first.vectors().collect()}
    assert 0 < len(done) < 40
    switch.unlink()
    store = S.sync_embeddings(first, rows(spark, texts), logged(str(log)), DIMS, waves=4)
    assert sorted(r.hash for r in store.vectors().collect()) == sorted(f"h{t}" for t in texts)
    sent = [t for c in calls(log) for t in c]
    assert all(sent.count(h[1:]) == 1 for h in done)  # what was published is not embedded again


def test_quarantine_is_tried_again(spark, tmp_path):
    switch = tmp_path / "broken"
    switch.write_text("")

    def sometimes():
        def service(texts):
            if os.path.exists(str(switch)) and "b" in texts:
                raise OSError("down")
            return letters()(texts)

        return service

    store = S.sync_embeddings(S.open_store(spark, str(tmp_path / "s")), rows(spark, ["a", "b"]), sometimes, DIMS, attempts=1)
    assert [tuple(r) for r in store.quarantined().collect()] == [("hb", "OSError: down")] and store.vectors().count() == 1
    switch.unlink()
    store = S.sync_embeddings(store, rows(spark, ["a", "b"]), sometimes, DIMS)
    assert store.quarantined().count() == 0 and store.vectors().count() == 2


def test_gate_rerank_and_prepared_query(spark):
    docs = spark.createDataFrame([(1, "eee"), (2, "xe"), (3, "none at all"), (4, None), (5, "ee")], "id long, text string")
    assert sorted(r.id for r in S.gated(docs, "text", share_of_e, 0.5).collect()) == [1, 2, 5]
    assert [r.id for r in S.reranked(docs, "text", "id", share_of_e, 9).collect()] == [1, 5, 2, 3, 4]
    maps = spark.createDataFrame([({" yes": -0.5, "NO": -1.0},), ({"NO": -0.1},), ({},)], "m map<string,double>")
    assert [round(r[0], 6) for r in maps.select(S.yes_probability(F.col("m"))).collect()] == [0.606531, 0.0, 0.0]
    q = S.PreparedQuery("ee")
    with pytest.raises(RuntimeError):
        q.vector
    assert abs(sum(x * x for x in q.prepare(letters(), DIMS).vector) - 1) < 1e-12
    with pytest.raises(RuntimeError):
        q.prepare(letters(), DIMS)
