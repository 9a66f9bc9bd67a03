"""License scans, whitening and periodic runs against plain Python, and rows that share a doc_id."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import bitsliced, jaccard, licenses, lines, periodic, queries, suffixes, whitening

SPACE = "[\x20\x09-\x0d]+"
CLASHING = "doc_id long, text string, runs string, collapsed int, n_words int, spans int, template int, tag int, n int, width int, votes int, label string"


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6, 7, 8, "y") for i, t in texts], CLASHING)


# --- 13 ---


def plain_runs(w, least=6, periods=4):
    """All runs by looking at every lag and place."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            part = w[s : s + n]
            if n >= max(least, periods * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(r, most):
    parts = []
    for _ in range(r.integers(1, 6)):
        base = r.integers(0, r.integers(1, 5), r.integers(1, 14))
        parts += [np.tile(base, r.integers(1, 12)), r.integers(0, 30, r.integers(0, 9))]
    return [f"w{x}" for x in np.concatenate(parts)[:most]]


@pytest.mark.parametrize("heavy", [0.01, 2.0, 1e9])
def test_lag_counts_and_runs(heavy):
    r = np.random.default_rng(5)
    texts = [looped(r, 300) for _ in range(60)] + [[], ["one"], ["a"] * 400, ["a", "b"] * 100]
    ids = np.array([int(zlib.crc32(w.encode())) for t in texts for w in t])
    cut = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    total, base = periodic.lag_counts(ids, cut, heavy=heavy)
    for o, t in enumerate(texts):
        m = total[base[o] : base[o + 1]]
        assert m.tolist() == [0] + [sum(t[i] == t[i + q] for i in range(len(t) - q)) for q in range(1, len(t) // 4 + 1)]
        assert [tuple(x) for x in periodic.runs_of(ids[cut[o] : cut[o + 1]], m).tolist()] == plain_runs(t)


def test_long_text_of_one_word_is_scanned_once(monkeypatch):
    seen = []
    scan = periodic.lag_islands
    monkeypatch.setattr(periodic, "lag_islands", lambda w, lag, need: seen.append(lag) or scan(w, lag, need))
    w = np.zeros(100_000, np.int64)
    total, _ = periodic.lag_counts(w, np.array([0, len(w)]))
    assert periodic.runs_of(w, total).tolist() == [[0, 100_000, 1]] and seen == [1]


def test_periodic_runs(spark):
    r = np.random.default_rng(8)
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "é é é é é é é é é é é é", "x " * 30_000]
    texts += ["\n".join(looped(r, 400)) + "  " for _ in range(30)]
    rows = [*enumerate(texts), (None, "b b b b b b b"), (5, "a a a a a a"), (5, "other text")]
    got = periodic.periodic_runs(rows_of(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and got[0].__fields__[-2:] == ["runs", "collapsed"] and got[0].n_words == 2
    found = sorted((g.doc_id if g.doc_id is not None else -1, g.text or "", [tuple(x) for x in g.runs], g.collapsed) for g in got)
    want = []
    for i, t in rows:
        w = words(t)
        runs = [(0, 30_000, 1)] if len(w) == 30_000 else plain_runs(w)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        want.append((i if i is not None else -1, t or "", runs, " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert found == sorted(want)
    assert periodic.periodic_runs(rows_of(spark, []).select("doc_id", "text")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(rows_of(spark, []), min_periods=2)


def test_strongest_run_is_exact(spark):
    runs = [(0, 13, 3), (20, 26, 6), (50, 9, 2), (60, 9, 2), (70, 4_000_000_001, 888_888_889)]
    best = spark.createDataFrame([(runs,), ([],)], "runs " + periodic.RUNS).select(periodic.strongest(F.col("runs")).alias("b")).collect()
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0]))
    assert tuple(best[0].b) == top and best[1].b is None


def test_periodic_query_by_plain_python(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, data).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w, h = words(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = got[d.doc_id]
        runs = [(s, m, q) for s, m, q in plain_runs(w)] if n < 1500 else None
        if runs is None:
            continue
        assert r.n_runs == len(runs)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_license_scan", "op13_periodic_runs"])
def test_queries_against_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{data}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want.select(", ".join(sorted(want.columns))).fetchall()))


# --- 11 ---


def plain_places(t):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))
    return w, [(i, x) for i in range(len(w)) for p, x in licenses.PHRASES if w[i : i + len(p.split())] == p.split()]


def test_license_report(spark):
    mit, gpl = licenses.NOTICES[1][0], licenses.NOTICES[5][0]
    near = mit.replace("free of charge", "wholly free of any charge")
    texts = [None, "", "...", "license", "The MIT License (MIT).", "mit\nlicense mit license, Apache-License", "General public. LICENSE", "general public open license", "general public x public license"]
    texts += [f"/* {mit.upper()} */ {gpl}", near, " ".join(mit.split()[:9]), "größe mit license ß", "word " * 20_000 + "GNU general public license", "mit license " * 5000, "licensed under CC BY-NC 4.0."]
    rows = [*enumerate(texts), (None, "mit license"), (4, texts[4]), (4, "a text of its own, apache license")]
    docs = rows_of(spark, rows)
    got = licenses.license_report(docs.repartition(3)).collect()
    assert len(got) == len(rows) and got[0].label == "y" and got[0].runs == "x"
    by = {(g.doc_id, g.text): g for g in got}
    for key, g in by.items():
        w, base = plain_places(key[1])
        assert (g.n_words, g.n_base) == (len(w), len(base)), key
        assert (g.first_word, g.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert g.base_labels == ",".join(sorted({x for _, x in base})) and set(g.base_labels.split(",")) - {""} <= set(g.labels.split(","))
        assert 0 <= g.score <= 1
    assert by[9, texts[9]].labels == "gpl,mit" and by[9, texts[9]].score == 1.0
    assert by[10, near].labels == "mit" and 0.8 <= by[10, near].score < 1
    assert by[11, texts[11]].labels == "" and 0 < by[11, texts[11]].score < 0.8
    assert by[15, texts[15]].labels == "cc-by-nc" and by[3, "license"].score == 0
    assert licenses.license_report(rows_of(spark, []).select("doc_id", "text")).count() == 0


def test_hash_meetings_are_verified(spark, monkeypatch):
    """A gram of other words that met a template's hash would vote for it; the words decide."""
    other = licenses.template_positions(spark, [licenses.Template("in mit", "mit", 2, 0)])
    own = licenses.template_positions(spark, licenses.TEMPLATES)
    monkeypatch.setattr(licenses, "template_positions", lambda *_: own.unionByName(other))
    docs = spark.createDataFrame([(1, "no word in mit licenses"), (2, "in mit license")], "doc_id long, text string")
    spans = licenses.voted_spans(docs.select("doc_id", F.xxhash64("text").alias("tag"), "text"), licenses.TEMPLATES).collect()
    assert sorted(len(r.found) for r in spans) == [1, 2]
    assert [(r.n_base, r.first_word) for r in licenses.license_report(docs).orderBy("doc_id").collect()] == [(0, None), (1, 1)]


# --- 12 ---


def plain_whitening(x, wanted):
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[: min(wanted, x.shape[1])]
    return e[order], c @ u[:, order] / np.sqrt(e[order]), ((n * x - s) ** 2).sum(1), e.sum()


@pytest.mark.parametrize("case", ["flat", "steep", "narrow"])
def test_whitening(spark, case):
    r = np.random.default_rng(2)
    dims = {"flat": 48, "steep": 60, "narrow": 5}[case]
    m = r.normal(size=(400, dims)) @ np.diag(1.5 ** -np.arange(dims) * 300 if case == "steep" else np.linspace(2, 1, dims))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(m)]
    odd = [(1000, None, "x"), (1001, [None] * dims, "x"), (1002, [float("nan")] * dims, "x"), (1003, [float("inf")] + [0.0] * (dims - 1), "x"), (1004, [], "x"), (1005, [1e300] * dims, "x"), (None, m[3].tolist(), "x"), (7, m[7].tolist(), "x")]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n string").repartition(4)
    x = np.floor(64 * np.concatenate([m, m[[3, 7]]])).astype(np.int64) + 1_000_000
    e, white, deviation, trace = plain_whitening(x, 8)
    got = whitening.whiten(v, wanted=8).collect()
    k = min(8, dims)
    assert len(got) == 402 * k and {g.n for g in got} == {402}
    table = np.zeros((400, k))
    for g in got:
        if g.vec_id is not None:
            table[g.vec_id, g.component - 1] = g.whitened
            assert g.deviation == deviation[g.vec_id]
        assert abs(g.explained / (e[g.component - 1] / trace) - 1) < 1e-9 and g.identity_error < 1e-9
    sign = np.sign((table * white[:400]).sum(0))
    assert np.abs(table * sign - white[:400]).max() < 1e-6


def test_range_finder_grows_only_where_it_must(spark):
    r = np.random.default_rng(4)
    for scale, full in ((4.0 ** -np.arange(40) * 1e6, False), (np.ones(40), True)):
        x = np.floor(r.normal(size=(500, 40)) * scale * 100).astype(int)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(3)
        c = whitening.principal_components(rows, 40, wanted=6)
        assert c.full == full
        e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:6]
        assert np.allclose(c.values, e, rtol=1e-10)


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0  # no variance
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [5.0])], kind)).collect()
    assert sorted((g.vec_id, g.component, round(abs(g.whitened), 9), g.explained) for g in one) == [(i, 1, 1.0, 1.0) for i in (1, 2, 3, 4)]
    big = [2**51, -(2**51)]
    away = whitening.deviations(np.array([big], np.int64), 2**20, [0, 0])
    assert away.tolist() == [[2**71, -(2**71)]]


# --- rows that share a doc_id ---


def test_unlike_texts_of_one_id_keep_what_repeats_nowhere(spark):
    r = np.random.default_rng(6)
    say = lambda n: "".join(r.choice(list("abcdefgh "), n))
    a, c, b = say(400), say(300), say(150)
    docs = spark.createDataFrame([(0, a), (1, c + a), (1, b), (1, b), (2, b + "!")], "doc_id long, text string")
    got = {(g.doc_id, g.n_bytes): g for g in suffixes.substring_dedup(docs).collect()}
    assert got[1, 150].n_removed == 0 and got[1, 700].n_removed == 400 and got[2, 151].n_removed == 150
    assert all(g.n_removed <= g.n_bytes for g in got.values())
    line = "a line that stands in many documents, again and again"
    own = "precious first line that stands nowhere else, as it is"
    rows = [(i, f"{line}\nx{i}") for i in range(6)] + [(1, f"{own}\n{line}")]
    kept = {(g.doc_id, g.text): g.kept for g in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[1, f"{own}\n{line}"] == own and kept[1, f"{line}\nx1"] == "x1" and kept[5, f"{line}\nx5"] == f"{line}\nx5"
    say_words = lambda n: " ".join(say(6) for _ in range(n))
    base, alone = say_words(80), say_words(60)
    rows = [(0, base), (1, base + " more"), (1, alone), (2, base + " again")]
    left = jaccard.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((g.doc_id, g.text) for g in left) == sorted(rows[:3])


def test_empty_vectors_score_zero(spark):
    v = bitsliced.quantised(spark.createDataFrame([(0, []), (1, []), (2, [1.0]), (3, None)], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, bitsliced.top_k(v.where("vec_id = 0"), v).collect())) == [(0, 1, 1, 0)]
