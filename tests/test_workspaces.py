"""Workspaces: the fold against a plain replay, in batch and as a stream."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorequarry.plans import registry
from lorequarry.plans.stream_queries import QUOTAS, workspace_log
from lorequarry.streaming import workspaces as W

DATA = "/root/testdata/sf0.001"


def plain(log, q):
    """(outcomes, files) of log rows by one dictionary for each workspace; totals are kept as one counter that forgets on refusal."""
    spaces, out = {}, []
    for w, seq, op, name, content, find, new in sorted(log, key=lambda r: (r[0], r[1], *[(x is not None, x or "") for x in r[2:]])):
        s = spaces.setdefault(w, {"files": {}, "n": 0})
        name_, content, find, new = (x or "" for x in (name, content, find, new))
        key, line = name_.lower(), None
        if op == "write":
            if not re.fullmatch("[A-Za-z0-9._-]+", name_):
                error = "bad name"
            elif len(content) > q.each:
                error = "content too long"
            elif key not in s["files"] and len(s["files"]) >= q.files:
                error = "too many files"
            else:
                if key in s["files"]:
                    s["n"] -= len(s["files"][key][1])
                if s["n"] + len(content) > q.total:
                    error = "workspace full"
                    if q.strict and key in s["files"]:
                        s["n"] += len(s["files"][key][1])
                else:
                    error = None
                    s["files"][key] = (s["files"].get(key, (name_,))[0], content)
                    s["n"] += len(content)
        elif key not in s["files"]:
            error = "nothing to find" if op == "edit" and not find else "no such file"
        elif op == "delete":
            error = None
            s["n"] -= len(s["files"].pop(key)[1])
        else:
            own, text = s["files"][key]
            parts = text.split(find) if find else [""]
            if not find:
                error = "nothing to find"
            elif len(parts) == 1:
                error = "text not found"
            elif len(parts) > 2:
                at, lines = 0, []
                for part in parts[:-1]:
                    at += len(part)
                    lines.append(text[:at].count("\n") + 1)
                    at += len(find)
                error = f"text found {len(parts) - 1} times, in lines " + ", ".join(map(str, dict.fromkeys(lines)))
            else:
                error, line = None, parts[0].count("\n") + 1
                s["files"][key] = (own, new.join(parts))
                s["n"] += len(new) - len(find)
        out.append((w, seq, op, name, error, line))
    return out, sorted((w, *f) for w, s in spaces.items() for f in s["files"].values())


def random_log(n, seed):
    r = np.random.default_rng(seed)
    names = ["a.md", "A.MD", "b.md", "c.md", "d.md", "bad name", "", None]
    say = lambda: "".join(r.choice(list("xy\nz"), r.integers(0, 14))) if r.random() > 0.05 else None
    pick = lambda x: x[int(r.integers(0, len(x)))]
    return [(f"w{int(r.integers(0, 7)) % 5}", i, pick(["write", "write", "edit", "delete"]), pick(names), say(), pick(["x", "xy", "\n", ""]), say()) for i in range(n)]


@pytest.mark.parametrize("strict", [False, True])
def test_batch_replay(spark, strict):
    q = W.Quotas(files=3, each=11, total=22, strict=strict)
    log = random_log(600, 4)
    done = W.replayed(spark.createDataFrame(log, W.LOG).repartition(5), q)
    want, left = plain(log, q)
    assert sorted(map(tuple, W.outcomes(done).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, W.files(done).collect())) == left
    assert len({o[4] for o in want if o[4]}) >= 8


def test_refused_write_does_not_count_later(spark):
    q = W.Quotas(files=2, each=10, total=12)
    log = [("w", 1, "write", "a", "x" * 8, None, None), ("w", 2, "write", "b", "x" * 9, None, None), ("w", 3, "write", "b", "xxxx", None, None), ("w", 4, "write", "c", "x", None, None), ("w", 5, "delete", "a", None, None, None), ("w", 6, "write", "c", "x" * 8, None, None)]
    got = [r.error for r in W.outcomes(W.replayed(spark.createDataFrame(log, W.LOG), q)).orderBy("seq").collect()]
    assert got == [None, "workspace full", None, "too many files", None, None]


def test_incomplete_rows_and_empty_log(spark):
    log = [(None, 1, "write", "a", "x", None, None), ("w", None, "write", "a", "x", None, None), ("w", 1, None, "a", "x", None, None), ("w", 2, "move", "a", "x", None, None)]
    got = sorted(r.error for r in W.outcomes(W.replayed(spark.createDataFrame(log, W.LOG))).collect())
    assert got == ["incomplete"] * 3 + ["unknown operation"]
    assert W.replayed(spark.createDataFrame([], W.LOG)).count() == 0


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    q = W.Quotas(files=3, each=11, total=22)
    log = random_log(300, 9)
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (log[:100], log[100:180], log[180:] + [("w0", 5, "write", "a.md", "x", None, None)]):  # each run goes on from the checkpoint
            spark.createDataFrame(part, W.LOG).coalesce(1).write.mode("append").parquet(source)
            stream = W.replayed_stream(spark.readStream.schema(W.LOG).parquet(source), q)
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
            query.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = plain(log, q)[0] + [("w0", 5, "write", "a.md", "late", None)]
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=repr) == sorted(want, key=repr)


def test_registered_replay_over_all_conversations(spark):
    log = [tuple(r) for r in workspace_log(spark, DATA).collect()]
    want, left = plain(log, QUOTAS)
    assert sorted(map(tuple, registry.queries()["snk4_workspace_outcomes"](spark, DATA).collect()), key=repr) == sorted(want, key=repr)
    got = registry.queries()["aw4_workspace_files"](spark, DATA).collect()
    assert sorted((r.workspace, r.name, r.chars) for r in got) == [(w, n, len(c)) for w, n, c in left]
    assert {o[4] for o in want} >= {None, "too many files"} or pd.Series([o[4] for o in want]).notna().any()
    assert spark.range(1).select(F.lit(len(want))).first()[0] == len(log)
