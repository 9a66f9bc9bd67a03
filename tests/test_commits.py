"""The commit graph against plain Python on random histories."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.operators import commits as G

KIND = "sha string, parents array<string>, author string, time timestamp, message string"


def history(n, seed):
    """Random commits: long lines, branches, merges of two and three parents, several roots, a parent that is missing."""
    r = np.random.default_rng(seed)
    name = lambda i: f"{(i * 7919) % 10007:04x}{i:06x}"
    rows = []
    for i in range(n):
        kind = r.random()
        near = [int(x) for x in r.integers(max(0, i - 12), i, 3)] if i else []
        if i in (0, n // 2):
            parents = []
        elif kind < 0.7:
            parents = [i - 1]
        elif kind < 0.85:
            parents = near[:1]
        else:
            parents = list(dict.fromkeys([i - 1, *near]))
        names = [name(p) for p in parents] + (["missing"] if i == n // 3 else [])
        rows.append((name(i), names or ([] if i else None), f"A{i % 4}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), f"m{i}"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return history(160, 5)


@pytest.fixture(scope="module")
def graph(spark, rows):
    return G.Graph(spark.createDataFrame(rows, KIND).repartition(3))


def up(parents, sha, n):
    for _ in range(n):
        own = parents.get(sha) or []
        if not own or own[0] not in parents:
            return None
        sha = own[0]
    return sha


def below(parents, tips):
    seen, open_ = set(), [t for t in tips if t in parents]
    while open_:
        c = open_.pop()
        if c not in seen:
            seen.add(c)
            open_ += [p for p in parents[c] or [] if p in parents]
    return seen


def test_ancestors(spark, graph, rows):
    parents = {r[0]: r[1] for r in rows}
    asked = [(r[0], n) for i, r in enumerate(rows) for n in (0, 1, i % 9, i // 2, 5000)] + [("unknown", 0), (rows[5][0], None), (rows[5][0], -1)]
    got = G.ancestors(graph, spark.createDataFrame(asked, "sha string, hops long")).collect()
    for r in got:
        want = None if r.hops is None or r.hops < 0 else ("unknown" if r.sha == "unknown" else up(parents, r.sha, r.hops))
        assert r.ancestor == want, r
    assert len(graph.levels) <= 8  # tables grow with the logarithm of the longest line


def test_reachable_and_range(spark, graph, rows):
    parents = {r[0]: r[1] for r in rows}
    tips = lambda *i: spark.createDataFrame([(rows[x][0],) for x in i] + [("missing",)], "sha string")
    for ends in ((159,), (40, 90), (0,)):
        assert {r.sha for r in G.reachable(graph, tips(*ends)).collect()} == below(parents, [rows[x][0] for x in ends])
    assert G.reachable(graph, spark.createDataFrame([("missing",)], "sha string")).count() == 0
    got = {r.sha for r in G.commit_range(graph, tips(100), tips(159, 80)).collect()}
    assert got == below(parents, [rows[159][0], rows[80][0]]) - below(parents, [rows[100][0]])


def test_rev_parse(spark, graph, rows):
    parents = {r[0]: r[1] for r in rows}
    refs = spark.createDataFrame([("HEAD", rows[159][0]), ("main", rows[100][0]), ("cafe", rows[7][0])], "name string, sha string")
    whole = rows[30][0]
    short = next(whole[:n] for n in range(4, 11) if sum(r[0].startswith(whole[:n]) for r in rows) == 1)
    want = {
        "HEAD": (rows[159][0], None),
        "HEAD^": (up(parents, rows[159][0], 1), None),
        "HEAD^3": (up(parents, rows[159][0], 3), None),
        "HEAD^2~2": (up(parents, rows[159][0], 4), None),
        "main~4": (up(parents, rows[100][0], 4), None),
        "cafe": (rows[7][0], None),
        whole: (whole, None),
        short + "~1": (up(parents, whole, 1), None),
        whole[:3]: (None, "unknown"),
        "nowhere": (None, "unknown"),
        "HEAD~x": (None, "malformed"),
        "HEAD~1~2": (None, "malformed"),
        "main^2": (None, "unknown"),
        "~3": (None, "malformed"),
        "": (None, "malformed"),
        "HEAD~99999": (None, "not enough parents"),
    }
    got = {r.rev: (r.sha, r.error) for r in G.rev_parse(graph, refs, spark.createDataFrame([(x,) for x in want] + [(None,)], "rev string")).collect()}
    assert got.pop(None) == (None, "malformed") and got == want


def test_ambiguous_beginnings(spark):
    g = G.Graph(spark.createDataFrame([("abcd1", []), ("abcd2", []), ("abcd", ["abcd1"])], "sha string, parents array<string>"))
    refs = spark.createDataFrame([], "name string, sha string")
    got = {r.rev: (r.sha, r.error) for r in G.rev_parse(g, refs, spark.createDataFrame([("abcd",), ("abcd2",), ("abcd~1",)], "rev string")).collect()}
    assert got == {"abcd": ("abcd", None), "abcd2": ("abcd2", None), "abcd~1": ("abcd1", None)}
    g = G.Graph(spark.createDataFrame([("abcd1", []), ("abcd2", [])], "sha string, parents array<string>"))
    assert G.rev_parse(g, refs, spark.createDataFrame([("abcd",)], "rev string")).first().error == "ambiguous"


def test_log_and_show(spark, graph, rows):
    changes = spark.createDataFrame([(rows[3][0], "Src/a.py", "M", 3, 1), (rows[3][0], "src", "A", 1, 0), (rows[3][0], "srcs/b", "M", 9, 9), (rows[4][0], "src/a.py", "D", 0, 4)], "sha string, path string, status string, added long, deleted long")
    some = spark.createDataFrame([(rows[i][0],) for i in (3, 4, 5)], "sha string")
    got = {r.message: (r.files, r.added, r.deleted, [c.path for c in r.changes]) for r in G.show(graph.commits, changes, some, "AM", ("SRC/",)).collect()}
    assert got == {"m3": (2, 4, 1, ["Src/a.py", "src"]), "m4": (0, 0, 0, []), "m5": (0, 0, 0, [])}
    moment = dt.datetime(2024, 1, 1, 0, 30)
    got = [r.sha for r in G.log(graph.commits, no_merges=True, since=F.lit(moment), until=F.lit(moment + dt.timedelta(minutes=20)), author="^a[12]$", limit=6).orderBy(F.desc("time"), "sha").collect()]
    want = sorted((r for r in rows if len(r[1] or []) <= 1 and moment <= r[3] <= moment + dt.timedelta(minutes=20) and r[2] in ("A1", "A2")), key=lambda r: (-r[3].timestamp(), r[0]))[:6]
    assert got == [r[0] for r in want] and len(got) == 6


def test_status(spark):
    kind = "path string, hash string"
    head = [("same", "1"), ("edited", "2"), ("gone", "3"), ("old1", "4"), ("old2", "4"), ("lost", "5")]
    index = [("same", "1"), ("edited", "2b"), ("new1", "4"), ("new2", "4"), ("new3", "4"), ("added", "6"), ("lost", "5")]
    work = [("same", "1"), ("edited", "2c"), ("new1", "4"), ("new2", "x"), ("new3", "4"), ("added", "6"), ("loose", "7")]
    got = {(r.path, r.staged + r.unstaged, r.old) for r in G.status(*[spark.createDataFrame(x, kind) for x in (head, index, work)]).collect()}
    assert got == {("edited", "MM", None), ("gone", "D ", None), ("new1", "R ", "old1"), ("new2", "RM", "old2"), ("new3", "A ", None), ("added", "A ", None), ("lost", " D", None), ("loose", "??", None)}


def test_tables_of_a_line_hold_a_few_rows_a_commit(spark):
    graph = G.Graph(spark.range(1500).selectExpr("concat('c', id) AS sha", "IF(id = 0, array(), array(concat('c', id - 1))) AS parents"))
    assert G.ancestors(graph, spark.createDataFrame([("c1499", 1400)], "sha string, hops long")).first().ancestor == "c99"
    assert sum(t.count() for t in [*graph.steps, *graph.levels]) < 6 * 1500  # a table of all commits for each power holds 11 * 1500
