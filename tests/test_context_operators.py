"""Grep by rank, context around references, stored indexes, chunk prefixes and control columns against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.operators import context, control, lexical, markdown
from lorequarry.plans import document_queries
from lorequarry.session import table

DATA = "/root/testdata/sf0.001"


def test_search_equals_the_index(spark, tmp_path):
    docs = table(spark, DATA, "documents").unionByName(spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    query = spark.createDataFrame([("thand re tion thand schu ereau",)], "query string")
    rounded = lambda df: sorted((r.id, round(r.score, 9)) for r in df.collect())
    for document in (None, "source"):
        index = lexical.build_index(docs, "doc_id", "text", document)
        want = rounded(lexical.bm25(index, query))
        assert rounded(lexical.search(docs, query, document_col=document)) == want and len(want) > 20
    at = str(tmp_path / "index")
    lexical.save_index(index, at)
    stored = lexical.search_index(lexical.load_index(spark, at), "thand re tion thand schu ereau")
    assert rounded(stored) == want
    assert "In(term" in stored._jdf.queryExecution().executedPlan().toString() or "PushedFilters" in stored._jdf.queryExecution().executedPlan().toString()
    assert lexical.search(docs.where("doc_id < 0"), query).count() == 0


FILES = [("a/x.md", "# Top\n\n[def one] first words here\n\n- item one\n- item two\n\n## Sub\n\nlast paragraph of the file"), ("b.md", "plain"), ("c.md", "")]


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    nodes = markdown.parse(files)
    return files, nodes, markdown.tags(nodes, "def")


def test_fetch_context(spark, parsed):
    files, nodes, definitions = parsed
    text = FILES[0][1]
    item = text.index("- item two")
    last = text.index("last")
    refs = [(1, f"a/x.md:{item + 2},{item + 4}"), (1, "a/x.md@one"), (1, "b.md"), (2, f"a/x.md:{last},{last + 4}"), (2, "a/"), (2, "a/x.md@none"), (2, "missing.md"), (3, "b.md:0,400"), (3, None)]
    got = context.fetch_context(spark.createDataFrame(refs, "request int, ref string"), files, nodes, definitions).collect()
    found = {(r.request, r.path, r.start): (r.text, r.refs) for r in got}
    one = text.index("[def one]")
    assert found == {
        (1, "a/x.md", one): ("[def one] first words here", ["a/x.md@one"]),
        (1, "a/x.md", item): ("- item two", [f"a/x.md:{item + 2},{item + 4}"]),
        (1, "b.md", 0): ("plain", ["b.md"]),
        (2, "a/x.md", last): ("last paragraph of the file", [f"a/x.md:{last},{last + 4}"]),
        (3, "b.md", 0): ("plain", ["b.md:0,400"]),
    }
    merged = context.fetch_context(spark.createDataFrame(refs, "request int, ref string"), files, nodes, definitions, gap=100).where("request = 1 AND path = 'a/x.md'").collect()
    assert len(merged) == 1 and len(merged[0].refs) == 2 and merged[0].text == text[one : item + 10]
    cut = context.fetch_context(spark.createDataFrame(refs, "request int, ref string"), files, nodes, definitions, budget=30).where("request = 1").collect()
    assert sorted(r.text for r in cut) == ["- it", "[def one] first words here"]


def test_block_of_a_list_is_the_heading_above(spark, parsed):
    _, nodes, _ = parsed
    text = FILES[0][1]
    a, b = text.index("- item one"), text.index("- item two") + 4
    got = context.block_nodes(spark.createDataFrame([("a/x.md", a, b)], "path string, s int, e int"), nodes).first()
    assert (got.start, got.end) == (0, len(text))


def test_registered_fetch_covers_all_files(spark):
    got = document_queries.QUERIES["df2_fetch_context"][0](spark, DATA).collect()
    docs = table(spark, DATA, "documents").collect()
    content = {f"{d.source}/{d.doc_id}.md": f"# Doc {d.doc_id}\n\n[def d{d.doc_id}] [dependsOn src1/{d.doc_id + 20}.md]\n\n{d.text}\n\n- one\n- two\n" for d in docs}
    for r in got:
        assert content[r.path][r.start : r.end_].startswith(r.text) and r.refs
    per = {}
    for r in got:
        per[r.request] = per.get(r.request, 0) + len(r.text)
    assert set(per) == {d.doc_id // 4 for d in docs} and max(per.values()) <= 8192


def test_grep_content(spark):
    rows = [(i, f"f{i % 3}.md", i, i + 9, f"needle word{i}\r\n" + "x" * 80) for i in range(12)] + [(99, "g.md", 0, 1, "nothing")]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, start long, end long, raw string")
    query = spark.createDataFrame([("needle",)], "query string")
    got = context.grep_content(chunks, query, most_files=2).collect()
    assert sorted((r.path, r.start) for r in got) == [("f0.md", 0), ("f0.md", 3), ("f0.md", 6), ("f1.md", 1), ("f1.md", 4), ("f1.md", 7)]
    assert {(r.more_ranges, r.more_files) for r in got} == {(1, 1)} and all("\n" not in r.snippet and "\r" not in r.snippet and r.snippet.endswith("...") for r in got)
    assert {r.path for r in context.grep_content(chunks, query, path_filter="f2").collect()} == {"f2.md"}


def test_unshown_blocks(spark):
    rows = [(1, 0, "a", 5, 10, 20, [0]), (1, 1, "a", 6, 12, 15, [0, 5]), (1, 2, "a", 7, 20, 30, [0]), (1, 3, "a", 8, 12, 28, [0]), (1, 4, "b", 8, 12, 28, [0]), (1, 5, "a", 9, 25, 35, [0]), (2, 0, "a", 6, 12, 15, [0, 5]), (2, 1, "a", 5, 10, 20, [0])]
    m = spark.createDataFrame(rows, "conv long, pos long, path string, node_id int, start int, end int, ancestors array<int>")
    assert {(r.conv, r.pos) for r in context.unshown_blocks(m).collect()} == {(1, 0), (1, 2), (1, 4), (1, 5), (2, 0), (2, 1)}


def test_chunk_prefix_and_identity(spark):
    content = "# Top\n\n## Sub [def s]\n\nbody [def b] [dependsOn x.md] [dependsOn y.md]\n\n```py\ncode\n```\n\n- item"
    nodes = markdown.parse(spark.createDataFrame([("p.md", content)], "path string, content string"))
    got = {r.raw.split()[0]: r for r in markdown.chunks(nodes).collect()}
    body, code, item = got["body"], got["code"], got["item"]
    start = content.index("body")
    end = content.index("\n\n```")
    sub = "Sub [def s]"
    assert body.chunk_text == f"[Document: p.md]\n[Headings: Top > {sub}]\n[Offsets: {start}, {end}]\n[Definitions: b, s]\n[Dependencies: x.md, y.md]\n[Document Tree: Top > {sub}]\n\n{content[start:end]}"
    assert "[Code Block (py)]\n\ncode" in code.chunk_text and "[List Item]\n\nitem" in item.chunk_text and "[Definitions: s]" in code.chunk_text
    identity = f"p.md\n#1 Top\n#2 {sub}\n0 \n{start}{start + len(body.raw)}\n{body.chunk_text}"
    assert body.hash == hashlib.sha256(identity.encode()).hexdigest().upper()
    assert "```py```" not in identity and code.hash != body.hash
    long = markdown.parse(spark.createDataFrame([("p.md", "word " * 900)], "path string, content string"))
    pieces = markdown.chunks(long).orderBy("chunk").collect()
    whole = long.where("type = 'Paragraph'").first().text
    assert all(whole[p["at"] : p["at"] + len(p.raw)] == p.raw for p in pieces) and len(pieces) > 3


def test_references_inside_a_document(spark):
    deps = spark.createDataFrame([("a", "@x"), ("a", "@y"), ("b", "@x"), ("b", "c.md")], "path string, ref string")
    known = spark.createDataFrame([("a", 1, "x")], "path string, node_id int, value string")
    assert {tuple(r) for r in markdown.unresolved_local(deps, known).collect()} == {("a", "@y"), ("b", "@x")}


def test_control_columns(spark):
    cases = [("1 + 2 * 3", "7"), ("0.1 + 0.2", "0.3"), ("-(2 ** 3) % 5", "-3"), ("1/4", "0.25"), ("1/0", None), ("2 m", None), ("abs(1)", None), (None, None), ("9" * 2001, None), ("10 ** 5000", None), ("1e2", "100")]
    df = spark.createDataFrame([(i, e) for i, (e, _) in enumerate(cases)], "i int, e string").select("i", control.evaluated(F.col("e")).alias("v"))
    assert {r.i: r.v for r in df.collect()} == {i: v for i, (_, v) in enumerate(cases)}
    names = spark.createDataFrame([("a/b.md",), ("../b.md",), ("a/../../b.md",), ("a/../b.MD",), ("/a.md",), ("c:\\a.md",), ("a.txt",), (None,)], "p string")
    assert [r.ok for r in names.select(control.publishable(F.col("p")).alias("ok")).collect()] == [True, False, False, True, False, False, False, False]
    files = spark.createDataFrame([("ok-1.md", "x"), ("a b", "x"), ("x" * 65, "x"), ("a", "x" * 65_537), (None, "x")], "n string, c string")
    assert [r.e for r in files.select(control.attachment_errors(F.col("n"), F.col("c")).alias("e")).collect()] == [None, "name", "name length", "content length", "name"]


def test_parser_hands_on_small_batches():
    files = [(f"{i}.md", f"# H{i}\n\ntext {i}\n\n- a\n- b\n") for i in range(5000)] + [("long.md", "word " * 300_000), ("none.md", None)]
    sizes, rows = [], []
    for b in markdown.node_batches(iter(files)):
        sizes.append(b.num_rows)
        rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
    assert max(sizes) < 2010 and len(sizes) > 10
    assert rows == [(p, x[1]) for p, c in files for x in markdown._tree(p, c or "")]


def test_unshown_blocks_against_all_pairs(spark):
    r = np.random.default_rng(4)
    rows = []
    for conv, path in [(c, p) for c in range(30) for p in "abc"]:
        for pos in r.permutation(40).tolist():
            start = int(r.integers(0, 200))
            rows.append((conv, pos * 3 + ord(path), path, int(r.integers(0, 60)), start, start + int(r.integers(0, 30)), [int(x) for x in r.integers(60, 75, 2)]))
    want = set()
    for key in {(x[0], x[2]) for x in rows}:
        shown, bounds = set(), []
        for x in sorted((x for x in rows if (x[0], x[2]) == key), key=lambda x: x[1]):
            if shown.isdisjoint((x[3], *x[6])) and not any(a <= x[4] and x[5] <= b for a, b in bounds):
                shown.add(x[3])
                want.add((x[0], x[1]))
                near = [v for v in bounds if v[0] <= x[5] and x[4] <= v[1]]
                bounds = [v for v in bounds if v not in near] + [(min([x[4], *[v[0] for v in near]]), max([x[5], *[v[1] for v in near]]))]
    m = spark.createDataFrame(rows, "conv long, pos long, path string, node_id int, start int, end int, ancestors array<int>")
    found = context.unshown_blocks(m)
    assert {(x.conv, x.pos) for x in found.collect()} == want
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no call of Python for each file


def test_expressions_of_one_shape_are_parsed_once():
    control._shape.cache_clear()
    assert [control._exact(f"({i} + 0.5) * -{i % 7} ** 2", 64) for i in (3, 700)] == ["-31.5", "0"]
    assert control._shape.cache_info().misses == 1
    assert [control._exact(e, 64) for e in (" -12", "1 + 2 # 3", "n + 1", "n # 1", "07", "07.5", "1_01", "2 * \n3")] == ["-12", "3", None, None, None, "7.5", "101", None]
