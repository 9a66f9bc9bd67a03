"""Snippets against a plain version, on small cases and over all documents."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.functions.text import STOP_WORDS
from lorequarry.operators import snippets as S
from lorequarry.plans import registry
from lorequarry.plans.search_queries import QUERY

DATA = "/root/testdata/sf0.001"
BLANKS = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def plain(text, asked, base=0, context=35, most=10, desired=4):
    """(start, end, snippet, terms) rows, one character at a time."""
    found, at = [], 0
    for line in text.split("\n"):
        body = line[:-1] if line.endswith("\r") else line
        places = [[m.start() for m in re.finditer(re.escape(t), body, re.I)] for t in asked]
        for turn in range(max(map(len, places), default=0)):
            for i, own in enumerate(places):
                if turn < len(own) and len(found) < most:
                    lo, hi = max(0, own[turn] - context), min(len(body), own[turn] + len(asked[i]) + context)
                    found.append((at + lo, at + hi, i))
        at += len(line) + 1
    merged = []
    for lo, hi, i in sorted(found):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], hi), merged[-1][2] | {i})
        else:
            merged.append((lo, hi, {i}))
    shown, out = set(), []
    for _ in range(max(len(asked), desired)):
        best = max(merged, key=lambda r: (len(r[2] - shown), -r[0]), default=None)
        if best is None or not best[2] - shown:
            break
        shown |= best[2]
        lo, hi = best[:2]
        while lo > 0 and text[lo] not in BLANKS:
            lo -= 1
        while hi < len(text) and text[hi] not in BLANKS:
            hi += 1
        while lo < hi and text[lo] in BLANKS:
            lo += 1
        while hi > lo and text[hi - 1] in BLANKS:
            hi -= 1
        out.append((base + lo, base + hi, ("..." if lo else "") + text[lo:hi] + ("..." if hi < len(text) else ""), len(best[2])))
    return out


def shown(spark, cases, **how):
    """Snippets of each case; cases with the same terms are one table."""
    out = [None] * len(cases)
    for asked in {tuple(a) for _, a, _ in cases}:
        rows = [(i, t, b) for i, (t, a, b) in enumerate(cases) if tuple(a) == asked]
        df = spark.createDataFrame(rows, "i int, text string, base int")
        for r in df.select("i", S.snippets_of(F.col("text"), list(asked), F.col("base"), **how).alias("s")).collect():
            out[r.i] = [tuple(s) for s in r.s]
    return out


def test_small_cases(spark):
    cases = [
        ("some text here", ["nonexistent"], 100),
        ("prefix target suffix", ["target"], 50),
        ("some match here", ["match"], 100),
        ("prefix target suffix", ["TARGET"], 0),
        ("first alpha second\nthird bravo fourth", ["alpha", "bravo"], 0),
        ("hit one two three four hit", ["hit"], 0),
        ("prefix\ntarget\nsuffix", ["target"], 0),
        ("little majesty", ["lit"], 0),
        ("", ["anything"], 0),
        ("some text", [], 0),
        ("alpha beta gamma middle delta epsilon zeta", ["middle"], 10),
        (None, ["x"], 0),
        ("a.b\\E(c) [x] a.b\\E(c)", ["\\E(", "", "[x]"], 7),
        ("crlf target\r\nnext target\r\n", ["target"], 0),
        ("ÉTÉ été 😀 été", ["été", "😀"], 3),
    ]
    got = shown(spark, cases)
    assert got[0] == [] and got[8] == [] and got[9] == [] and got[11] == []
    assert got[1] == [(50, 70, "prefix target suffix", 1)] and got[2] == [(100, 115, "some match here", 1)]
    assert [s[2] for s in got[4]] == ["first alpha second...", "...third bravo fourth"]
    assert len(got[5]) == 1 and got[6] == [(7, 13, "...target...", 1)] and got[7] == [(0, 14, "little majesty", 1)]
    assert got == [plain(t or "", [x for x in a if x], b) for t, a, b in cases]


@pytest.mark.parametrize("how", [{}, {"context": 5, "most": 3, "desired": 1}, {"context": 0, "most": 40, "desired": 9}])
def test_random_texts(spark, how):
    r = np.random.default_rng(3)
    bits = ["ab", "aba", "cd", "x", " ", " ", "\n", "\r\n", "\t", "long" * 12, "　", "é"]
    asked = [[str(t) for t in r.choice(["ab", "ba", "CD", "é", "g", "aba"], n, replace=False)] for n in (1, 2, 3, 4)]
    cases = [("".join(r.choice(bits, r.integers(0, 200))), asked[i % 4], int(r.integers(0, 50))) for i in range(160)]
    assert shown(spark, cases, **how) == [plain(*c, **how) for c in cases]


def test_one_frequent_term_leaves_room_for_others(spark):
    text = "spam " * 300 + "egg"
    got = shown(spark, [(text, ["spam", "egg"], 0)], context=2)[0]
    assert sum(s[3] for s in got) == 2 and any("egg" in s[2] for s in got)


def test_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    asked = [QUERY.lower(), *dict.fromkeys(w for w in re.findall(r"[^\W_]{2,}", QUERY.lower()) if w not in STOP_WORDS)]
    got = {}
    df = registry.queries()["hy11_snippets"](spark, DATA)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    for r in df.collect():
        got.setdefault(r.id, {})[r.nth] = (r.start, r.end, r.snippet, r.terms)
    want = {d.doc_id: s for d in docs if (s := plain(d.text or "", asked))}
    assert {i: [s for _, s in sorted(own.items())] for i, own in got.items()} == want and len(want) > 10


def test_lines_of_a_report(spark):
    df = spark.createDataFrame([("some match here",)], "text string")
    assert df.select(S.snippet_lines(S.snippets_of(F.col("text"), ["match"], 100))).first()[0] == "      'some match here':100,115"
