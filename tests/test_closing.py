"""Conversations that end: batch against a plain fold, stream against batch, and items that fail."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from lorequarry.streaming import closing as C

START = dt.datetime(2024, 1, 1)


def turns(rows):
    return [(c, START + dt.timedelta(seconds=s), role, text) for c, s, role, text in rows]


def plain(rows, gap):
    out = []
    for conv in {r[0] for r in rows}:
        part = []
        for t in sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: (t[0], t[1] == "end", t[1], t[2])) + [None]:
            if part and (t is None or part[-1][1] == "end" or (t[0] - part[-1][0]).total_seconds() >= gap):
                said = [x for x in part if x[1] != "end"]
                if said:
                    out.append((conv, part[0][0], part[-1][0], len(said), "\n".join(f"{a}: {b}" for _, a, b in said), "ended" if part[-1][1] == "end" else "timeout"))
                part = []
            if t:
                part.append(t)
    return sorted(out)


def random_turns(n, seed):
    r = np.random.default_rng(seed)
    return turns((f"c{int(r.integers(0, 6))}", int(r.integers(0, 4000)), "end" if r.random() < 0.05 else str(r.choice(["user", "assistant"])), str(i)) for i in range(n))


def run(spark, source, out, at, late):
    stream = C.closed_stream(spark.readStream.schema(C.TURNS).option("maxFilesPerTrigger", 1).parquet(source), 300, late)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(240)


def test_batch_form(spark):
    rows = random_turns(400, 1)
    got = sorted(map(tuple, C.closed(spark.createDataFrame(rows, C.TURNS).repartition(4), 300).collect()))
    assert got == plain(rows, 300) and {g[5] for g in got} == {"ended", "timeout"}
    odd = [(None, START, "user", "x"), ("c", None, "user", "x"), ("d", START, None, None), ("e", START, "end", "x")]
    assert [tuple(r) for r in C.closed(spark.createDataFrame(odd, C.TURNS), 300).collect()] == [("d", START, START, 1, ": ", "timeout")]
    assert C.closed(spark.createDataFrame([], C.TURNS), 300).count() == 0


def test_stream_with_late_turns_and_a_restart(spark, tmp_path):
    rows = sorted(random_turns(300, 2), key=lambda r: r[1])
    r = np.random.default_rng(3)
    jumbled = [rows[i] for i in np.argsort(np.arange(len(rows)) + r.uniform(0, 30, len(rows)), kind="stable")]  # out of order by some minutes
    last = turns([("zz", 100_000, "user", "moves the watermark")])
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (jumbled[:120], jumbled[120:220], jumbled[220:], last):  # each run goes on from the checkpoint of the one before
            spark.createDataFrame(part, C.TURNS).coalesce(1).write.mode("append").parquet(source)
            run(spark, source, out, at, "20 minutes")
        before = spark.read.parquet(out).count()
        spark.createDataFrame(turns([("c1", 10, "user", "far too late"), ("zz", 100_001, "user", "again")]), C.TURNS).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out, at, "20 minutes")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == plain(rows, 300) and len(got) == before  # each closed once, and what comes after the watermark changes nothing


ITEMS = [("a", "0"), ("b", "49"), ("c", "50"), ("d", "raise x"), ("e", "fail"), ("f", " \n"), ("g", None), ("h", "3")]
WANT = {"a": (1, None), "b": (50, None), "c": (50, "not done after 50 turns"), "d": (1, "KeyError: 'raise x'"), "e": (1, "refused"), "f": (0, "blank"), "g": (0, "blank"), "h": (4, None)}


def make_factory():
    done, go_on = C.DONE, C.GO_ON

    def factory():
        def step(text, turn):
            if text.startswith("raise"):
                raise KeyError(text)
            if text.startswith("fail"):
                return "refused"
            return done if turn == int(text) else go_on

        return step

    return factory


def test_items_fail_alone(spark):
    items = spark.createDataFrame(ITEMS, "id string, text string")
    got = C.worked(items, "text", make_factory()).collect()
    assert {g.id: (g.steps, g.error) for g in got} == WANT


def test_work_stream_writes_dead_letters_once(spark, tmp_path):
    source, good, dead, at = (str(tmp_path / x) for x in ("in", "good", "dead", "checkpoint"))
    for i in (0, 4):
        spark.createDataFrame(ITEMS[i : i + 4], "id string, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id string, text string").parquet(source)
        C.work_stream(stream, "text", make_factory(), good, dead, at).awaitTermination(240)
    # the last batch's commit is lost, so it is done again
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    C.work_stream(spark.readStream.schema("id string, text string").parquet(source), "text", make_factory(), good, dead, at).awaitTermination(240)
    assert sorted(r.id for r in spark.read.parquet(good).collect()) == [i for i, w in sorted(WANT.items()) if not w[1]]
    assert {r.id: r.error for r in spark.read.parquet(dead).select("id", "error").collect()} == {i: w[1] for i, w in WANT.items() if w[1]}
    assert spark.read.parquet(dead).where(F.col("id") == "d").count() == 1
