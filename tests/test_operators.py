"""Operators that SQL can't express, and behaviour at the edges."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import control, files, hybrid, markdown, relational, snippets, vectors
from lorequarry.sources import readers
from lorequarry.streaming import events

INVENTED = "ba be bi bo bu da de di do du fa fe fi fo fu ga".split()


def nodes_of(text):
    return markdown._tree("p", text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# Abcd Efgh\n## IJK ##\n### lmn ###", [("Heading", "Abcd Efgh"), ("Heading", "IJK"), ("Heading", "lmn")]),
        ("```\nabcd\nefgh\n```\n", [("CodeBlock", "abcd\nefgh")]),
        ("- item one\n  continuation\n- item two\n", [("List", ""), ("ListItem", "item one\ncontinuation"), ("ListItem", "item two")]),
        ("> q\n>r\n\n- - -\ntext", [("Blockquote", "q\nr"), ("ThematicBreak", ""), ("Paragraph", "text")]),
        ("", []),
    ],
)
def test_markdown_blocks(text, want):
    assert [(n[4], n[8]) for n in nodes_of(text)[1:]] == want


@pytest.mark.parametrize("seed", range(20))
def test_markdown_invariants(seed):
    r = random.Random(seed)
    say = lambda: " ".join(r.choices(INVENTED, k=r.randint(1, 8)))
    make = [lambda: "#" * r.randint(1, 6) + " " + say(), say, lambda: "- " + say(), lambda: "1. " + say(), lambda: "```\n" + say() + "\n```", lambda: "***", lambda: "> " + say()]
    text = "\n\n".join(r.choice(make)() for _ in range(60))
    nodes = nodes_of(text)
    by_id = {n[1]: n for n in nodes}
    for n in nodes[1:]:
        parent = by_id[n[2]]
        assert parent[6] <= n[6] <= n[7] <= parent[7] <= len(text)
        assert n[10] == [*parent[10], parent[1]] and n[3] == len(n[10])
    for kind in ("Heading", "Paragraph"):
        for n in nodes:
            if n[4] == kind:
                assert n[8] in text[n[6] : n[7]]


def test_chunks_and_sync(spark):
    long = "First line here.\n" * 90 + "One sentence. Two sentences! Three? " + "x" * 2500
    df = spark.createDataFrame([("a/b.md", f"# Top\n\n## Sub\n\nshort\n\n{long}\n\n```\ncode\n```")], "path string, content string")
    nodes = markdown.parse(df)
    got = markdown.chunks(nodes, 1000).orderBy("node_id", "chunk").collect()
    assert all(len(c.chunk_text) <= 1000 for c in got)
    assert got[0].chunk_text == "[Document: a/b.md]\n[Headings: Top > Sub]\n[Offsets: 15, 20]\n[Document Tree: Top > Sub]\n\nshort" and got[0].raw == "short"
    assert len({c.hash for c in got}) == len({(c.node_id, c["at"]) for c in got}) == len(got)
    assert markdown.sync(markdown.chunks(nodes), markdown.chunks(nodes)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("path/to/dir/", ("Directory", "path/to/dir/", None, None, None)),
        ("a.md:99999999999,1", ("File", "a.md:99999999999,1", None, None, None)),
        ("a:b.md:-1,+7", ("Offsets", "a:b.md", None, -1, 7)),
        ("@x", ("Directory", "@x", None, None, None)),
        (" a.md", ("File", " a.md", None, None, None)),
        ("d/.hidden", ("Directory", "d/.hidden", None, None, None)),
        ("path/to/File.md", ("File", "path/to/File.md", None, None, None)),
        ("path/to/Folder", ("Directory", "path/to/Folder", None, None, None)),
        ("path/to/File.md@Basics", ("Definition", "path/to/File.md", "Basics", None, None)),
        ("path/to/File.md:10,20", ("Offsets", "path/to/File.md", None, 10, 20)),
        ("  ", None),
        (None, None),
    ],
)
def test_reference(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(markdown.parse_reference(F.col("t")).alias("r")).first().r
    assert (None if got is None else tuple(got)) == want


def test_terms(spark):
    row = lambda t: spark.createDataFrame([(t,)], "t string").select(T.terms(F.col("t")).alias("a"), T.terms_with_query(F.col("t")).alias("b")).first()
    assert row("the and for are but").a == [] and row("a bc de fgh").a == ["bc", "de", "fgh"] and row("DX1 dx1 Dx1").a == ["dx1"] * 3
    assert row("DX1, system-config (alpha)!").b == ["dx1, system-config (alpha)!", "dx1", "system", "config", "alpha"]


def test_fusion_adds_both_lists(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = {r.id: r.score for r in hybrid.reciprocal_rank_fusion([a, b]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


def test_bounding_trees_take_the_highest_parent(spark):
    rows = [(0, None, 0, 0, 100, []), (1, 0, 1, 0, 60, [0]), (2, 1, 2, 0, 30, [0, 1]), (3, 2, 3, 0, 10, [0, 1, 2]), (4, 1, 2, 30, 60, [0, 1]), (5, 0, 1, 60, 100, [0])]
    nodes = spark.createDataFrame(rows, "node_id int, parent_id int, depth int, start int, end int, ancestors array<int>")
    hits = spark.createDataFrame([(3, 1.0), (4, 3.0), (5, 0.5)], "node_id int, score double")
    got = {r.root: (r.hits, r["mean"], r.chars) for r in hybrid.bounding_trees(hits, nodes).collect()}
    assert got == {1: (2, 2.0, 60), 5: (1, 0.5, 40)}


def test_snippets(spark):
    t = spark.createDataFrame([(1, "x" * 100 + " match here and match again\nno\nmatch")], "id long, text string")
    got = snippets.snippets(t, spark.createDataFrame([("match again",)], "query string"), context=5).orderBy("nth").collect()
    assert [(r.nth, r.snippet, r.terms) for r in got] == [(1, "x" * 100 + " match here and match again...", 3)]  # the last line shows no further term


def test_dependency_cycles(spark):
    p = spark.createDataFrame([("a",), ("b",)], "plugin string")
    e = spark.createDataFrame([("a", "b", "hard"), ("b", "a", "hard")], "plugin string, depends_on string, kind string")
    with pytest.raises(ValueError, match="cycle"):
        control.dependency_levels(p, e, 5)


def test_paths():
    assert files.sandboxed("a/./b/../c.md") == "a/c.md"
    for bad in ("/a", "..", "a/../../b", "C:\\x"):
        with pytest.raises(ValueError):
            files.sandboxed(bad)


def test_code_and_imports(spark, tmp_path):
    for name, content in {"repoA/src/A.cs": "class A\r\n{}\r\n", "repoA/bin/junk.cs": "x", "repoA/.git/config": "x", "repoB/b.ts": "let b", "repoB/c.bin": "a\0b"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content, newline="")
    got = readers.read_code(spark, str(tmp_path))
    assert {r.path for r in got.collect()} == {"repoA/src/A.cs", "repoB/b.ts"}
    assert [r.text for r in files.lines(got.where("path LIKE '%.cs'")).orderBy("line").collect()] == ["class A", "{}"]
    data = [{"name": "one", "position": {"x": 1, "y": 2, "z": 3}, "size": 4, "ores": [{"id": "Fe", "volume": 5}, None]}, {"ores": []}, {"name": "two", "ores": [{"id": "NI", "volume": 2, "estimated": True}]}]
    (tmp_path / "IMPORT_Alpha.json").write_text(json.dumps(data))
    sites, deposits = readers.read_imports(spark, str(tmp_path))
    assert sorted((r.instance, r.name, r.x) for r in sites.collect()) == [("alpha", "", 0.0), ("alpha", "one", 1.0), ("alpha", "two", 0.0)]
    assert sorted((r.name, r.kind, r.volume, r.estimated) for r in deposits.collect()) == [("one", "fe", 5.0, False), ("two", "ni", 2.0, True)]
    out = str(tmp_path / "snapshot")
    readers.replace_instances(sites, out)
    readers.replace_instances(sites.withColumn("instance", F.lit("beta")).limit(1), out)
    readers.replace_instances(sites.limit(1), out)
    assert {(r.instance, r["count"]) for r in spark.read.parquet(out).groupBy("instance").count().collect()} == {("alpha", 1), ("beta", 1)}


def test_throttle_and_debounce(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [(1, at(0), 10), (1, at(100), 119), (1, at(200), 1), (1, at(2199), 5), (1, at(2200), 5), (1, at(2300), 1), (2, at(0), 1)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, len int")
    got = sorted((r.key, r.total) for r in events.throttled(df).collect())
    assert got == [(1, 10), (1, 130), (1, 140), (1, 141), (2, 1)]
    bursts = sorted((r.key, r.n) for r in events.debounced(df).collect())
    assert bursts == [(1, 3), (1, 3), (2, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, len int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.sessions(stream, "15 minutes", "1 minute").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {(r.key, r.start, r.n) for r in spark.table("closed").collect()}
    batch = {(r.key, r.start, r.n) for r in events.sessions(df, "15 minutes").collect()}
    assert closed <= batch and len(batch - closed) <= 3
    q = events.ingest(stream, F.col("key") > 0, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 40 and spark.read.parquet(str(tmp_path / "dead")).count() == 20


def test_knn_recall_and_edges(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", vectors.sanitised(F.col("embedding")))
    q = v.where("vec_id = 5").first().embedding
    best = vectors.knn(v, q, 3).collect()
    assert best[0].vec_id == 5 and abs(best[0].score) < 1e-5
    assert vectors.knn(v, q, 100).count() == 60 and vectors.knn(v.where("vec_id < 0"), q, 3).count() == 0
    zero = spark.createDataFrame([([0.0, 1e-12],)], "v array<double>").select(vectors.sanitised(F.col("v")).alias("v")).first().v
    assert zero == [0.0, 0.0]


def test_summary_of_nothing(spark):
    s = spark.createDataFrame([], "site_id long, instance string, x double, y double, z double, mined boolean")
    d = spark.createDataFrame([], "site_id long, kind string, volume double, estimated boolean")
    got = relational.summary(relational.open_deposits(s, d, "a", "b")).first()
    assert (got.deposits, got.largest, got.richest, got.richest_total) == (0, 0.0, None, 0.0)
