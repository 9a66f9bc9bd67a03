"""The registered query of each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.llm import bitsliced, bpe, jaccard, licenses, lines, lm, mixing, neardup, periodic, pii, quality, suffixes, whitening


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_pseudonyms(spark, sf_dir):
    key = spark.conf.get("spark.lorequarry.pii.key", "a public key for the test tables")  # set a secret one for real data
    return pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op2_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_exact_top_k(spark, sf_dir):
    rows = bitsliced.quantised(_table(spark, sf_dir, "embeddings"))
    return bitsliced.top_k(rows.where("vec_id % 100 = 0"), rows)


def op4_suffix_array_dedup(spark, sf_dir):
    return suffixes.substring_dedup(_table(spark, sf_dir, "documents")).drop("removed")


def op5_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_bpe(spark, sf_dir):
    return bpe.bpe_codes(_table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], digests=True)


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_embedding_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_source_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_lm_scoring(spark, sf_dir):
    return lm.score_texts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op11_license_scan(spark, sf_dir):
    out = licenses.license_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), wanted=32)


def op13_periodic_runs(spark, sf_dir):
    docs = periodic.replanted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return periodic.periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (SELECT *, {LOWER.format(x=f"trim(line, {BLANKS})")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format(x="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT n.doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON a = n.doc_id GROUP BY 1, 2
"""

NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


# words of every text, with op13's repeats put in; crc32 of the doc_id's digits by shifts
RUNS_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS own,
    xor(list_reduce(flatten(list_transform(str_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents
), e AS (SELECT *, len(own)::BIGINT AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE own END AS w FROM f),
k AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM t),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
c AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.q < c.q AND c.q % b.q = 0 AND b.start <= c.start AND b.start + b.length >= c.start + c.length)),
g AS (SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256 FROM u GROUP BY 1),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, start, q) AS rank FROM u),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM u),
kept AS (SELECT k.r, string_agg(w, ' ' ORDER BY k.i) AS text FROM k ANTI JOIN gone ON gone.r = k.r AND gone.i = k.i GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, (1000 * length) // q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM t LEFT JOIN g ON g.r = t.r LEFT JOIN best ON best.r = t.r AND rank = 1 LEFT JOIN kept ON kept.r = t.r
"""

_TEMPLATES = ", ".join(f"({i}, '{t.text}', '{t.label}', {t.gram}, {t.slack})" for i, t in enumerate(licenses.TEMPLATES))
LICENSE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format(x="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT id, str_split(x, ' ') AS w, label, k, slack FROM (VALUES {_TEMPLATES}) v(id, x, label, k, slack)),
tg AS (SELECT id, k, slack, label, w, unnest(range(0, len(w) - k + 1)) AS j, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM t),
dg AS (SELECT r, k, unnest(range(0, len(w) - k + 1)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, (VALUES ({licenses.PHRASE_GRAM}), ({licenses.NOTICE_GRAM})) v(k) WHERE len(w) >= k),
v AS (SELECT r, id, i - j AS diagonal, min(j) AS lo, max(j + tg.k) AS hi FROM dg JOIN tg ON tg.g = dg.g AND tg.k = dg.k GROUP BY 1, 2, 3),
n AS (SELECT v.*, slack, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, v.id ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS new FROM v JOIN t ON t.id = v.id),
s AS (SELECT *, sum(new) OVER (PARTITION BY r, id ORDER BY diagonal) AS span FROM n),
p AS (SELECT r, id, span, diagonal, unnest(range(lo, hi)) AS j FROM s),
a AS (SELECT p.r, p.id, span, p.j, min(p.diagonal + p.j) AS i FROM p JOIN d ON d.r = p.r JOIN t ON t.id = p.id WHERE d.w[p.diagonal + p.j + 1] = t.w[p.j + 1] GROUP BY 1, 2, 3, 4),
o AS (SELECT r, a.id, min(label) AS label, min(k) = {licenses.PHRASE_GRAM} AS phrase, min(i) AS start, count(*) / min(len(w))::DOUBLE AS share FROM a JOIN t ON t.id = a.id GROUP BY r, a.id, span),
f AS (SELECT r, count(*) FILTER (phrase AND share = 1) AS n_base, min(start) FILTER (phrase AND share = 1) AS first_word, max(start) FILTER (phrase AND share = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase AND share = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= CASE WHEN phrase THEN 1 ELSE 0.8e0 END) AS labels, max(share) AS score FROM o GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0e0) AS score
FROM d LEFT JOIN f ON f.r = d.r
"""


def queries():
    return {f.__name__: f for f in (op1_pii_pseudonyms, op2_quality_classifier, op3_exact_top_k, op4_suffix_array_dedup, op5_line_dedup, op6_bpe, op7_ngram_jaccard, op8_embedding_near_dedup, op9_source_mixing, op10_lm_scoring, op11_license_scan, op12_embedding_whitening, op13_periodic_runs)}


def oracle_sql():
    return {"op11_license_scan": LICENSE_SQL, "op13_periodic_runs": RUNS_SQL, "op3_exact_top_k": TOP_K_SQL, "op5_line_dedup": LINES_SQL, "op7_ngram_jaccard": JACCARD_SQL, "op8_embedding_near_dedup": NEAR_SQL}
