"""The training-data operators against plain Python, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import copy
import hashlib
import itertools
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import bitsliced, bpe, components, jaccard, lines, lm, mixing, neardup, pii, quality, suffixes, textbytes
from lorequarry.llm.durable import durable
from lorequarry.llm.queries import tokenizer_path

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, node long, c int"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), t)


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", low(t or "")) if w]


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    vocab = ["".join(r.choice(list("abcdeéß🙂"), 4)) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab, n))
    base, shared, line = say(200), say(60), "A line That stands in many documents, again and again."
    out = [None, "", " \n\t ", "one", "Two words", base, base, base + " more", base.upper(), say(3000)]
    out += [say(30) + "\n" + line + "\n" + shared + " " + say(20) for _ in range(7)]
    out += ["  " + line.upper() + "\t\n" + say(5), "x\n\n" + line + "\n" + line, shared, say(50) + " " + shared, "\n", "a" * 350, "ab" * 130]
    tokens = base.split()
    out += [" ".join(tokens[:i] + ["changed"] + tokens[i + 1 :]) for i in (3, 60, 199)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "k", 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---


def test_pseudonyms(spark, empty):
    seen = ["4785380592391139", "und.34@mail7.example.com", "97.51.17.173", "+1 (017) 555-7713", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "1984-02-29", "31.12.1999"]
    left = ["1234567890123456", "999.1.1.1", "000-12-3456", "1983-02-29", "version 4.0.", "GB83 WEST 1234 5698 7654 32"]
    rows = [(1, " ".join(seen) + " end"), (2, "x " + seen[0] + "!! " + seen[1]), (3, " ; ".join(left)), (4, None), (5, ""), (6, "plain " * 5000)]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_replaced", F.lit("x")), "secret").collect()}
    assert got[1].n_replaced == len(seen) and not any(s in got[1].text for s in seen)
    assert [got[i].text for i in (3, 4, 5, 6)] == [rows[2][1], None, "", rows[5][1]]
    card = got[2].text.split("!!")[0][2:]
    assert card in got[1].text and len(card) == 16  # equal values stay linked
    digits = [int(c) for c in card][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    iban = re.search(r"GB\d\d(?: [A-Z0-9]{4}){4} [A-Z0-9]{2}", got[1].text).group(0).replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.pseudonymised(empty, "secret").count() == 0


def test_permutation_covers_its_range(spark):
    x = spark.range(898 * 7).select(pii.permute(F.col("id"), 898, 7, "k").alias("y"))
    assert x.distinct().count() == 898 * 7 and x.agg(F.max("y")).first()[0] == 898 * 7 - 1


def test_pseudonyms_of_a_format_are_a_permutation(spark):
    """Every date and SSN-like string of a whole range maps to another one of the range, no two to the same."""
    iso = spark.range(pii.DAYS).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("m"))
    early = spark.range(144 * 200).select(F.format_string("%02d/%02d/%04d", F.col("id") % 12 + 1, F.floor(F.col("id") / 12) % 12 + 1, 1900 + F.floor(F.col("id") / 144)).alias("m"))
    late = iso.where("substr(m, 9) > '12'")
    day_first, month_first = (late.select(F.date_format(F.col("m").cast("date"), form).alias("m")) for form in ("dd.MM.yyyy", "MM.dd.yyyy"))
    for strings in (iso, early, day_first, month_first):
        both = strings.select("m", pii.date(F.col("m"), "k").alias("p")).toPandas()
        assert set(both.p) == set(both.m) and len(set(both.m)) == len(both) > 28_000 and (both.p == both.m).sum() < 20
    pairs = spark.range(1600).select(F.format_string("%02d/%02d/2003", F.col("id") % 40, F.floor(F.col("id") / 40)).alias("m"))
    valid = pairs.where("try_to_date(m, 'dd/MM/yyyy') IS NOT NULL OR try_to_date(m, 'MM/dd/yyyy') IS NOT NULL")
    odd = pairs.join(valid, "m", "left_anti")
    assert odd.where(pii.date(F.col("m"), "k") != F.col("m")).count() == 0
    words = spark.range(26**3).select(F.concat(*[F.char((F.floor(F.col("id") / 26**i) % 26 + 97).cast("long")) for i in range(3)]).alias("m"))
    assert words.select(pii.permute_string(F.col("m"), "k").alias("p")).where("p rlike '^[a-z]{3}$'").distinct().count() == 26**3


# --- 2 ---


def test_quality_learns(spark, docs, empty):
    r = np.random.default_rng(1)
    say = lambda bad: " ".join("".join(r.choice(list("abcdefgh"), 5)) + ("%%%" if bad else "") for _ in range(r.integers(1, 60)))
    rows = [(i, say(i % 3 == 0), int(i % 3 != 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality.fit_quality(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    got = quality.score_quality(d.select("doc_id", "text", "quality"), net).collect()
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(g.predicted == g.quality for g in held) / len(held) > 0.97
    odd = quality.score_quality(docs, net).collect()  # nulls, empty and very long texts, extra columns
    assert len(odd) == docs.count() and all(0 <= g.score <= 1 for g in odd)
    assert quality.score_quality(empty, net).count() == 0
    none = quality.fit_quality(d.select("doc_id", "text"), d.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert none.constant == 0.5
    assert quality.good_documents(docs, d.select("doc_id", "quality")).columns == docs.columns


def test_long_text_is_scored_in_pieces():
    net = quality.ByteNet()
    data = np.random.default_rng(0).integers(97, 120, 50_000).astype(np.uint8)
    chunks, first = quality.padded_chunks(data, np.array([0, 30_000, 30_000, 50_000]))
    assert np.allclose(net.pooled(chunks, first), net.pooled(chunks, first, most=1000), atol=1e-5)


def test_pooling_against_plain_loops():
    net = quality.ByteNet(filters=5)
    texts = [b"", b"a", b"some words", "größer ".encode() * 9]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.probability(*quality.padded_chunks(np.frombuffer(b"".join(texts), np.uint8), offsets))
    w, step, span = net.w, quality.STEP, quality.SPAN
    for t, p in zip(texts, got, strict=True):
        raw = t + bytes((len(t) // step + span) * step - len(t))
        best = [-np.inf] * 5
        for at in range(0, len(raw) - span * step + 1, step):
            x = w["embed"][list(raw[at : at + span * step])].reshape(span, -1)
            best = np.maximum(best, sum(x[i] @ w["filters"][i] for i in range(span)))
        h = np.maximum(np.maximum(best + w["bias"], 0) @ w["dense"] + w["dense_bias"], 0)
        assert math.isclose(p, 1 / (1 + math.exp(-float(h @ w["out"] + w["out_bias"][0]))), rel_tol=1e-4)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("doc_id", "text", "quality", F.lit(1.5).alias("score"))
    got = quality.score_quality(held, quality.fit_quality(docs, labels)).collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.96 * len(got) > 100
    good = [r for r in got if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)


# --- 3 ---


def test_top_k_is_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, [1.0] * 7 + [None]), (502, [float("nan")] * 8), (503, [3.0] * 8), (504, [-2.5] * 8), (7, rows[3][1])]
    v = bitsliced.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)))
    got = collections.defaultdict(list)
    for x in bitsliced.top_k(v.where("vec_id % 100 = 0"), v, block_rows=64, batch_queries=3).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    ok = [(i, np.floor(1024 * np.array(e)).astype(np.int64)) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    for qid, q in ok:
        if qid % 100 == 0:
            best = sorted(((-int(e @ q), i) for i, e in ok if i != qid))[:10]
            assert got[qid] == [(i, -s) for s, i in best]
    assert bitsliced.top_k(v.where("vec_id < 0"), v).count() == 0
    few = v.where("vec_id < 3")
    assert bitsliced.top_k(few, few).count() == 6


# --- 4 ---


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeated_substrings(docs, texts, empty, crowd, monkeypatch):
    monkeypatch.setattr(suffixes.substring_spans, "__defaults__", (100, crowd))
    seen, want = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 99):
            if (w := b[a : a + 100]) in seen:
                gone[a : a + 100] = True
            seen.add(w)
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.substring_dedup(docs).collect()}
    assert got == want
    assert suffixes.substring_dedup(empty).count() == 0


def test_suffix_order():
    r = np.random.default_rng(1)
    for n in [*range(1, 25), 200, 301]:
        for k in (1, 2, 5):
            t = r.integers(1, k + 1, n)
            assert np.argsort(suffixes.difference_cover_order(t, 10**6), kind="stable").tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


# --- 5 ---


def test_line_dedup(docs, texts, empty):
    key = lambda x: low(x.strip(SPACE))
    holders = collections.defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    want = {}
    for i, t in texts:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        want[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    assert sum(w[1] for w in want.values()) >= 7
    for most_bits in (1 << 29, lines.CHUNK_BYTES * 8):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(docs, most_bits=most_bits).collect()}
        assert got == want
    assert lines.dedup_lines(empty).count() == 0
    again = lines.dedup_lines(docs.unionByName(docs)).collect()  # repeated rows are one document
    assert {(r.doc_id, r.kept) for r in again} == {(i, w[2]) for i, w in want.items()} and len(again) == 2 * len(want)


# --- 6 ---


def test_codes_are_those_of_the_library(docs, texts, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    odd = ["It's WE'LL <|endoftext|> x<|startoftext|>", "ΑΣ Σ İ ẞ ½ ٣", "\x1c\x1d á \x85 ​"]
    for t in [*(t or "" for _, t in texts), *odd]:
        ids = lib.encode(t, add_special_tokens=False).ids
        raw, text = bpe.tokenizer(tokenizer_path()).encode([t])[0]
        assert np.frombuffer(raw, "<u4").tolist() == ids and text.decode() == lib.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.bpe_codes(docs, tokenizer_path(), ["doc_id", "n"]).collect()}
    for i, t in texts:
        assert got[i].ids == lib.encode(t or "", add_special_tokens=False).ids and got[i].n == 1
    assert bpe.bpe_codes(empty, tokenizer_path(), ["doc_id"]).count() == 0


# --- 7 ---


def linked(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("page", [500_000, 300])
def test_jaccard_components(docs, texts, k, num, page):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, 100, page_shingles=page).collect()}
    assert got == linked(texts, k, num, 100)


def test_jaccard_edges(empty, docs):
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.one_of_each_group(docs).columns == docs.columns


@pytest.mark.parametrize("outlier", [False, True])
def test_pages_of_a_family_are_bounded(spark, outlier):
    """Near copies of one size (and with one far larger set) are dealt over pages, and all pages that can link meet."""
    sizes = [40] * 600 + [4000] * outlier
    sized = spark.createDataFrame([(i, 0, n, i, -i) for i, n in enumerate(sizes)], "node long, component long, n long, h1 long, h2 long")
    got = jaccard.paged(sized, 90, 100, 1000, docs_per_bucket=50).collect()
    assert sorted(r["__doc"] for r in got) == list(range(len(sizes)))
    held = collections.Counter()
    for r in got:
        if sizes[r["__doc"]] == 40:
            held[r.page] += 40
    assert len(held) >= 24 and max(held.values()) <= 1040
    for r in got:
        mates = {m.lo + m.hi - r.page for m in r.meets}
        assert len(mates) == len(r.meets)
        assert mates >= (set(held) if sizes[r["__doc"]] == 40 else {r.page})


def test_runs_of_contexts_stay_small():
    """Grams are never parted, and a run without a large gram stays in the cache of a core."""
    r = np.random.default_rng(6)
    gram, sizes = np.sort(r.integers(0, 5000, 40_000)), r.integers(100, 200, 40_000)
    bounds = suffixes.runs_of(gram, sizes)
    assert bounds[0] == 0 and bounds[-1] == len(gram) and all(gram[b - 1] != gram[b] for b in bounds[1:-1])
    assert max(sizes[a:b].sum() for a, b in itertools.pairwise(bounds)) < suffixes.RUN + 10_000 < 1 << 19


def test_output_layer_works_by_rows(monkeypatch):
    """A batch never holds the probabilities of all its places at once, and blocks give what one block gives."""
    net = lm.Attention(200, 128)
    r = np.random.default_rng(7)
    ids, target = r.integers(0, 200, (64, lm.WINDOW)), r.integers(0, 128, (64, lm.WINDOW))
    got, seen = [], []
    exp = np.exp
    monkeypatch.setattr(lm.np, "exp", lambda x, **k: (seen.append(x.shape), exp(x, **k))[1])
    for rows in (lm.ROWS, 1 << 20):
        monkeypatch.setattr(lm, "ROWS", rows)
        seen.clear()
        y = net.forward(ids)["y"].reshape(-1, 16)
        got.append((net.gradients(ids, target, np.ones(ids.shape, bool)), net.log_classes(y, target.reshape(-1))))
        assert max(s[0] for s in seen if len(s) == 2) == min(rows, ids.size)
    (g, p), (g2, p2) = got
    assert all(np.allclose(g[k], g2[k], atol=1e-6) for k in ("out", "bias", "up", "down", "mix", "qkv", "place"))
    assert np.allclose(p, p2, atol=1e-5) and min(512, ids.size) == 512


def test_packed_points_are_small():
    r = np.random.default_rng(5)
    points = [jaccard.point(np.unique(r.integers(0, 2**63, n).astype(np.uint64))) for n in (1, 64, 700, 40_000)]
    points.append(jaccard.point(np.arange(300, dtype=np.uint64) << np.uint64(20)))  # all in one group
    raw = [jaccard.packed(p) for p in points]
    assert all(len(x) <= (p.sum(dtype=int) + len(p)) // 8 + 1 for x, p in zip(raw, points, strict=True))
    assert all(np.array_equal(x, p) for x, p in zip(jaccard.unpacked(raw), points, strict=True))


def test_pages_meet_in_rounds(spark, monkeypatch):
    """Near copies that are dealt over many pages: what is shipped at once stays near what the pages hold, and its shuffle files go."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(40)]
    held, shipped = [], []
    dealt = jaccard._task_rows
    monkeypatch.setattr(jaccard, "_task_rows", lambda m, *a: (shipped if held else held).append(m.agg(F.sum("n")).first()[0]) or dealt(m, *a))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 100, page_shingles=300).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 40
    assert sum(x or 0 for x in shipped) > 6 * held[0] and max(x or 0 for x in shipped) < 6 * held[0]


def test_durable_releases_shuffle_files(spark):
    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before = files()
    assert durable(spark.range(1000).repartition(5, "id"), "rows").count() == 1000
    left = files() - before
    assert spark.range(1000).repartition(5, "id").toArrow().num_rows == 1000 and files() - before > left  # other queries keep theirs


def test_near_copies_over_several_pages_link(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(40)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 100, page_shingles=300).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 40


def test_signatures_lose_no_pair():
    r = np.random.default_rng(4)
    for num in (90, 80, 60):
        for _ in range(150):
            n = int(r.integers(1, 120))
            a = r.choice(2**60, n, replace=False).astype(np.uint64)
            most = jaccard.most_different(n, num, 100)
            add = int(r.integers(0, most + 1))
            b = np.concatenate([a[: max(1, n - (most - add))], r.choice(2**60, add, replace=False).astype(np.uint64)])
            i = len(np.intersect1d(a, b))
            if 100 * i >= num * (len(a) + len(b) - i) and set(a) != set(b):
                assert set(jaccard.signatures(np.sort(a), num, 100)) & set(jaccard.signatures(np.sort(b), num, 100))


def test_shared_passage_brings_few_sets_together(spark, monkeypatch):
    r = np.random.default_rng(12)
    passage = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"d{i}x{j}" for j in range(40)])) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 200, 20)]
    met, paged = [], jaccard.paged
    monkeypatch.setattr(jaccard, "paged", lambda sized, *a: met.append(sized.count()) or paged(sized, *a))
    shuffled = [rows[i] for i in r.permutation(len(rows))]
    got = jaccard.jaccard_components(spark.createDataFrame(shuffled, "doc_id long, text string"), 1, 80, 100).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i % 1000 for i, _ in rows}
    assert met[0] <= 4 * 20


def test_signatures_by_frequency_lose_no_pair():
    r = np.random.default_rng(14)
    often = r.integers(0, 4, 1 << 12).astype(np.uint8)
    for num in (100, 90, 80, 60):
        for n in (1, 3, 4, 5, 9, 10, 50, 120):
            for _ in range(20):
                a = r.integers(0, 2**64, n, dtype=np.uint64)
                b = np.concatenate([a[: n - int(r.integers(0, n // 4 + 1))], r.integers(0, 2**64, int(r.integers(0, n // 4 + 2)), dtype=np.uint64)])
                i = len(np.intersect1d(a, b))
                if 100 * i >= num * (len(a) + len(b) - i) and set(a) != set(b):
                    assert set(jaccard.signatures(np.sort(a), num, 100, often)) & set(jaccard.signatures(np.sort(b), num, 100, often))
                assert len(jaccard.signatures(np.sort(a), num, 100, often)) <= n - -(-n * num // 100) + 1


def test_components(spark):
    r = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}
    for a, b in pairs:
        x, y = root.get(a, a), root.get(b, b)
        lo = min(x, y)
        for n in [*root, a, b]:
            if root.get(n, n) in (x, y):
                root[n] = lo
    got = {x.node: x.component for x in components.components(spark.createDataFrame([*pairs, (5, None)], "a long, b long")).collect()}
    assert got == {n: c for n, c in root.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_texts_are_held_by_runs():
    words = [f"word{i} " * 20_000 for i in range(12)]
    column = pa.array([*words, None])
    runs = list(bpe._groups(column))
    assert [t for run in runs for t in run] == [*words, ""] and max(map(len, runs)) <= 5
    for part in (column, column.slice(3, 7), column.slice(11)):  # slices() shares the buffer of texts without nulls
        got = [data[a:b].tobytes().decode() for _, data, offsets in textbytes.slices(part) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [t or "" for t in part.to_pylist()]
    model = bpe.WordBpe(tokenizer_path())
    model.encode(["some words, some more"])
    assert model.codes and all(isinstance(c, bytes) for c in model.codes.values())


# --- 8 ---


def test_near_duplicate_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(0, 1, (60, 16))
    rows = []
    for i in range(300):
        v = base[i % 60] + r.normal(0, 0.05 if i % 3 else 0.12, 16)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(300 + i, rows[5][1], 1) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] + [0.0] * 14, 1), (403, [float("nan")] * 16, 1), (404, rows[5][1], None), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    ok = [(i, np.array(e) / np.linalg.norm(e), label) for i, e, label in rows if e and label is not None and None not in e and all(map(math.isfinite, e)) and any(e)]
    links = collections.defaultdict(set)
    for i, a, x in ok:
        for j, b, y in ok:
            if i != j and x == y and len(a) == len(b) and a @ b >= 0.93:
                links[i].add(j)
    comp = {}
    for i, *_ in rows:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    for cell_rows in (2048, 40, 5):  # one cell, some, very many: no link is lost
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in neardup.near_duplicates(v, cell_rows=cell_rows).collect()}
        assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i, *_ in rows}
    assert neardup.near_duplicates(v.where("vec_id < 0")).count() == 0


# --- 9 ---


def test_mix_meets_targets(docs, texts, empty, spark):
    got = mixing.mix_sources(docs).collect()
    size = {i: len(words(t)) for i, t in texts}
    assert {r.doc_id: r["size"] for r in got} == size and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = collections.defaultdict(int)
    for i, t in texts:
        by[f"s{i % 3}" if i % 4 else None] += size[i]
    order = sorted(x for x in by if x) + [None]
    target, weight = {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, rest = set(order), 1.5 * sum(by.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * by[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * by[s]
            rest -= target[s]
        open_ -= over
    for s in order:
        rows = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target[s]) and r.source_size == by[s] for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(docs.unionByName(docs)).count() == 2 * len(texts)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_spread_vectors_are_cut_into_blocks_only(spark):
    """Cells in which nearly all vectors are guests are dropped; blocks then give the links of all pairs."""
    r = np.random.default_rng(4)
    x = neardup.unit(r.normal(0, 1, (700, 64)))
    x[350:] = neardup.unit(x[:350] + r.uniform(0.03, 0.06, (350, 1)) * r.normal(0, 1, (350, 64)))
    reach = float(np.sqrt(2 - 2 * 0.93)) / 2
    groups = neardup.unit(np.eye(64)[r.integers(0, 64, 700)] + 0.02 * r.normal(0, 1, (700, 64)))
    assert neardup.products(x, neardup.spherical_kmeans(x, 12), reach) > 0.5 > neardup.products(groups, neardup.spherical_kmeans(groups, 12), reach)
    hit = x @ x.T >= 0.93
    v = spark.createDataFrame([(i, u.tolist(), 1) for i, u in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for block_rows in (100, 4096):
        got = {y.vec_id: y.n_links for y in neardup.near_duplicates(v, cell_rows=60, block_rows=block_rows).collect()}
        assert got == {i: int(n) - 1 for i, n in enumerate(hit.sum(1))} and sum(got.values()) > 100


# --- 10 ---


@pytest.mark.parametrize("frequent", [1_000_000, 3])
def test_language_model(docs, texts, empty, frequent):
    counts = collections.Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.score_texts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), frequent_words=frequent).collect()}
    for i, t in texts:
        w, r = [*words(t), None], got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.base_score + len(w) * math.log10(0.5) - 1e-6 <= r.score < 0
    assert lm.score_texts(empty, tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_output_layer_has_all_classes():
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    none = np.zeros(0, np.int64)
    net = lm.new_model(np.ones(lm.subwords(path).size), none, none, none, path)
    assert len(net.w["bias"]) == 128


def test_what_is_learned_grows_with_the_corpus(spark):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = spark.range(4000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 200), i -> concat('w', (id * 7 + i * i) % 300)), ' ') as text")
    n = [lm.chosen_windows(docs.where(F.col("doc_id") < m), path, 1 / 16).count() for m in (1000, 4000)]
    assert 3 * n[0] < n[1] < 5 * n[0]
    whole = lm.chosen_windows(docs.where("doc_id < 50"), path, 1.0)
    ids, scored = lm.unpacked(whole.toArrow())
    counts = {r.key: r.n for r in lm.corpus_counts(docs.where("doc_id < 50"), path).where("kind = 1").collect()}
    assert collections.Counter(ids[:, 1:][scored].tolist()) == counts  # at share 1 every id is learned from once


def test_weights_and_classes_are_learned_from_all_windows(spark, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = spark.range(4000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 200), i -> concat('w', (id * 7 + i * i) % 300)), ' ') as text")
    counts = np.zeros(lm.subwords(path).size)
    for r in lm.corpus_counts(docs, path).where("kind = 1").collect():
        counts[r.key] = r.n
    learned = []
    monkeypatch.setattr(lm.Change, "apply", lambda self, net: learned.append((self.n, int(self.met.sum()))))
    lm.fit_model(docs, counts, path, seed_windows=50)
    n = lm.chosen_windows(docs, path, 1.0).count()
    assert n > 60_000 and learned == [(n, n * lm.WINDOW)]
    own = np.argsort(-counts, kind="stable")[:20]
    ids, scored = lm.unpacked(lm.chosen_windows(docs.where("doc_id < 90"), path, 1.0).toArrow())
    place = {x: i for i, x in enumerate(own.tolist())}
    met = collections.Counter(b * 20 + place[a] for a, b in zip(ids[:, :-1][scored].tolist(), ids[:, 1:][scored].tolist(), strict=True) if a in place and b not in place)
    assert met and {r.pair: r.n for r in lm.pair_counts(docs.where("doc_id < 90"), path, own, 20).collect()} == met


def test_gradients_of_the_last_places(spark):
    net = lm.Attention(70_000, 5, dim=4, seed=1)
    r = np.random.default_rng(3)
    ids, target, valid = r.integers(0, 70_000, (3, lm.WINDOW)), r.integers(0, 5, (3, lm.WINDOW)), np.tile(np.arange(lm.WINDOW) >= 8, (3, 1))
    whole, last = net.gradients(ids, target, valid), net.gradients(ids, target, valid, lm.ADVANCE)
    assert all(np.allclose(x, y, atol=1e-6) for k in whole for x, y in zip(*[g[k] if k == "token" else [g[k]] for g in (whole, last)], strict=True))


def test_rounds_average_the_tasks(spark):
    """The mean over the tasks equals the same steps done here, task by task, and it lowers the loss."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = spark.range(300).selectExpr("id as doc_id", "array_join(transform(sequence(1, 150), i -> concat('w', (id * 7 + i * i) % 60)), ' ') as text")
    chosen = durable(lm.chosen_windows(docs, path, 1.0).repartition(3, "h").sortWithinPartitions("h"), "windows")
    sub = lm.subwords(path)
    none = np.zeros(0, np.int64)
    net = lm.new_model(np.ones(sub.size), np.arange(96), none, none, path)
    start = {k: v.copy() for k, v in net.w.items()}
    tasks = collections.defaultdict(list)
    for r in chosen.withColumn("task", F.spark_partition_id()).collect():
        tasks[r.task].append((bytes(r.ids), r.scored))
    lm.fit_round(net, chosen, 0.003)
    want, total = np.zeros_like(start["out"]), 0
    for rows in tasks.values():
        ids = np.frombuffer(b"".join(i for i, _ in rows), np.int32).reshape(-1, lm.WINDOW + 1)
        scored = np.array([[s >> j & 1 for j in range(lm.WINDOW)] for _, s in rows]) > 0
        own = copy.copy(net)
        own.w = {k: v.copy() for k, v in start.items()}
        adam, order = lm.Adam(own), np.random.default_rng(29).permutation(len(ids))
        for a in range(0, len(ids), 96):
            now = order[a : a + 96]
            adam.step(ids[now, :-1], own.class_of[ids[now, 1:]], scored[now], 0.003)
        want += (own.w["out"] - start["out"]) * len(ids)
        total += len(ids)
    assert np.allclose(net.w["out"] - start["out"], want / total, atol=1e-4)


def test_each_id_is_scored_once_and_causally():
    net = lm.Attention(50, 8)
    net.class_of = (np.arange(50) % 8).astype(np.int32)
    r = np.random.default_rng(0)
    lengths = np.array([1, 31, 32, 33, 200, 5])
    ids = r.integers(0, 50, lengths.sum())
    *_, scored, place = lm.windows(ids, lengths, 0)
    assert np.array_equal(np.sort(place[scored]), np.arange(len(ids)))
    whole = lm.log_probabilities(net, ids, lengths, 0)[0]
    cut = lm.log_probabilities(net, ids[:40], np.array([1, 31, 8]), 0)[0]
    assert np.allclose(whole[:40], cut[:40], atol=1e-5)


def test_places_of_hashes():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 1000, 50_000):
        keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        if n > 2:
            keys[: len(keys) // 2] >>= np.uint64(30)  # many in one bucket
            keys = np.unique(np.append(keys, np.uint64(2**64 - 1)))
        h = np.concatenate([keys, keys + np.uint64(1), r.integers(0, 2**64, 500, dtype=np.uint64)])
        assert np.array_equal(lm.Places(keys)(h), np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0)))


def test_words_that_share_a_slot():
    sub = lm.Subwords(tokenizer_path("byte_bpe_50k.tiktoken"))
    raw = b"alpha beta gamma delta"
    start = np.array([0, 6, 11, 17, 0, 11])
    end = np.array([5, 10, 16, 22, 5, 16])
    h = np.array([7, 8, 9, 10, 7, 9], np.uint64)  # one slot
    want = [sub.encode(" " + raw[a:b].decode()) for a, b in zip(start, end)]
    for own in ([0, 1, 2, 3, 4, 5], [3, 0, 2], [1], []):
        ids, n = sub.look_up(h[own], raw, start[own], end[own])
        assert ids.tolist() == [x for i in own for x in want[i]]
        assert n.tolist() == [len(want[i]) for i in own]


def test_words_sum_to_one():
    """Over a small vocabulary: all words of up to three subwords, and the end, after some history."""
    r = np.random.default_rng(3)
    size, end = 7, 6
    opens = np.array([1, 1, 1, 0, 0, 0, 1], bool)
    net = lm.Attention(size, 4)
    net.class_of = np.array([0, 1, 2, 2, 3, 3, 1], np.int32)
    counts = r.integers(1, 30, size).astype(float)
    mass = np.bincount(net.class_of, weights=counts)
    net.inside = np.log(counts / mass[net.class_of])
    net.opening = np.bincount(net.class_of, weights=np.exp(net.inside) * opens).astype(np.float32)
    history = [0, 3, 1]

    def p(word):
        ids = [*history, *word, end]
        return lm.word_probabilities(net, np.array(ids), np.array([2, 1, len(word), 1]), np.array([len(ids)]), end)[2]

    # plain forward pass: softmax over classes, then the share inside the class
    ids = np.array([*history, 2, end])
    previous = np.concatenate([[end], ids[:-1], np.zeros(lm.WINDOW - len(ids), int)])
    y = net.forward(previous[None])["y"][0]
    z = np.exp(y @ net.w["out"] + net.w["bias"])
    dist = (z / z.sum(1, keepdims=True))[:, net.class_of] * np.exp(net.inside)
    assert np.allclose(dist.sum(1), 1, atol=1e-5)
    assert math.isclose(p([2]), dist[3][2] / dist[3][opens].sum() * dist[4][opens].sum(), rel_tol=1e-3)
    words = [[a, *rest] for a in (0, 1, 2) for n in (0, 1, 2) for rest in itertools.product((3, 4, 5), repeat=n)]
    at_end = lm.word_probabilities(net, np.array([*history, end]), np.array([2, 1, 1]), np.array([4]), end)[2]
    total = sum(map(p, words)) + at_end
    longer = sum(map(p, [[a, *rest] for a in (0, 1, 2) for rest in itertools.product((3, 4, 5), repeat=3)]))
    assert 0.5 < total < total + longer <= 1 + 1e-6


def test_model_gradients():
    net = lm.Attention(20, 5, dim=4, seed=1)
    r = np.random.default_rng(0)
    ids, target, valid = r.integers(0, 20, (2, lm.WINDOW)), r.integers(0, 5, (2, lm.WINDOW)), r.random((2, lm.WINDOW)) < 0.7
    g = net.gradients(ids, target, valid)

    def loss():
        y = net.forward(ids)["y"].reshape(-1, 4)[valid.reshape(-1)]
        return -net.log_classes(y, target.reshape(-1)[valid.reshape(-1)])[0].mean()

    for name in ("qkv", "mix", "up", "down", "out", "place"):
        at = tuple(int(r.integers(s)) for s in net.w[name].shape)
        net.w[name] = net.w[name].astype(np.float64)
        keep = net.w[name][at]
        net.w[name][at] = keep + 1e-4
        up = loss()
        net.w[name][at] = keep - 1e-4
        slope = (up - loss()) / 2e-4
        net.w[name][at] = keep
        assert math.isclose(slope, float(g[name][at]), rel_tol=0.05, abs_tol=2e-4), name


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    kept = {r.doc_id: r.text for r in docs.collect()}
    groups = linked(sorted(kept.items()), 5, 80, 100)
    assert all(groups[i][1] == i for i in kept)  # no near-duplicates are left


# --- cases of the second round ---


def test_top_k_takes_every_length(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(0, 1, 2 if i < 20 else 8)]) for i in range(300)]
    v = bitsliced.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collections.Counter(x.query_id for x in bitsliced.top_k(v.where("vec_id % 10 = 0"), v, block_rows=64).collect())
    assert got == {i: 10 for i in range(0, 300, 10)}
    huge = bitsliced.quantised(spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="do not fit a long"):
        bitsliced.top_k(huge, huge).collect()


def test_line_dedup_with_clashing_names_and_hot_lines(docs, monkeypatch):
    plain = {(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(docs).collect()}
    clash = docs.select("doc_id", "text", F.lit("x").alias("kept"), F.lit(1).alias("dropped"), F.lit(2).alias("n_dropped"), F.lit(3).alias("keeper"))
    out = lines.dedup_lines(clash)
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()} == plain
    kept = lines.without_repeated_lines(clash)
    assert kept.columns == clash.columns and {(r.kept, r.n_dropped) for r in kept.collect()} == {("x", 2)} and kept.count() == docs.count()
    monkeypatch.setattr(lines, "HOT_DOCS", 5)
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(docs).collect()} == plain


def test_schedule_gives_every_block_a_slot(spark):
    plan = spark.createDataFrame([(0, 5, 0, 5), (1, 0, 5, 5), (2, 7000, 5, 7005), (3, 1, 7005, 7006)], "key int, slots long, `from` long, `to` long").withColumn("all_slots", F.lit(7006).cast("long"))
    got = collections.defaultdict(list)
    for r in mixing.schedule(plan).collect():
        got[r.key].append((r.rank, r.slot))
    assert {k: sorted(x[0] for x in v) for k, v in got.items()} == {0: list(range(5)), 2: list(range(7000)), 3: [0]}
    assert all([s for _, s in sorted(v)] == sorted(s for _, s in v) for v in got.values())
    slots = np.array(sorted(s for v in got.values() for _, s in v if len(v) > 5))
    a, m = mixing.FIBONACCI
    assert all(7006 * (((int(s) + 1) * a) % m) // m in range(5, 7005) for s in slots[:50])


def test_mix_of_documents_keeps_null_ids(spark):
    rows = [(None, "a b c d", "s"), (1, "e f g h", "s"), (1, "e f g h", "s"), (2, "i j", None), (3, None, "s")]
    out = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1)))
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got[(None, "a b c d")] >= 1 and got[(1, "e f g h")] >= 2 and (3, None) not in got


def test_points_bound_overlaps():
    """Pairs of the tree are those of all pairs by the same bound, and no linked pair is missing."""
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 120, dtype=np.uint64)
    sets = []
    for i in range(150):
        keep = base[r.random(120) < (0.97 if i % 2 else 0.6)]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, int(r.integers(1, 40)), dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    left, right, rows, cols = jaccard.trees([jaccard.point(s) for s in sets], sizes, None)
    assert len(left.levels) > 2
    found = set()
    for i, j, bound in jaccard.rtree_pairs(left, right, 80, 100):
        for a, b, c in zip(i.tolist(), j.tolist(), bound.tolist(), strict=True):
            assert c >= len(np.intersect1d(sets[a], sets[b])) and (a, b) not in found and (b, a) not in found
            found.add((a, b))
    side = np.arange(150) % 3 == 0
    crossed = {frozenset(p) for p in found if side[p[0]] != side[p[1]]}
    left, right, rows, cols = jaccard.trees([jaccard.point(s) for s in sets], sizes, side)
    assert {frozenset((int(rows[a]), int(cols[b]))) for i, j, _ in jaccard.rtree_pairs(left, right, 80, 100) for a, b in zip(i, j, strict=True)} == crossed
    for a in range(150):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                assert (a, b) in found or (b, a) in found


def test_chain_and_crowded_family(spark, monkeypatch):
    """A chain of near copies is one component, a crowd of texts just below the similarity is none; also with all pairs left open by the points."""
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(12):
        base = [*base[:i * 4], *(f"c{i}x{j}" for j in range(4)), *base[i * 4 + 4 :]]
        chain.append(" ".join(base))
    crowd = [" ".join(w if r.random() < 0.93 else f"r{r.integers(10**6)}" for w in (f"v{i}" for i in range(150))) for _ in range(60)]
    texts = list(enumerate([*chain, *crowd, *crowd[:3]]))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = linked(texts, 5, 80, 100)
    assert len({c for i, (_, c) in want.items() if i < 12}) == 1
    for page in (200_000, 2000):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, page_shingles=page).collect()} == want
    monkeypatch.setattr(jaccard, "likely_links", lambda points, *_: ([], [], True))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, page_shingles=2000).collect()} == want


def test_no_link_is_lost_at_the_threshold(spark):
    """Random 64-d vectors with partners at a cosine just above the threshold, in many cells at default settings."""
    r = np.random.default_rng(12)
    a = neardup.unit(r.normal(0, 1, (1500, 64)))
    side = r.normal(0, 1, (1500, 64))
    side = neardup.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * side
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([a, b]))]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cell_rows in (512, 60):
        got = {x.vec_id: (x.n_links, x.component_id) for x in neardup.near_duplicates(v, cell_rows=cell_rows).collect()}
        assert got == {i: (1, i % 1500) for i in range(3000)}
