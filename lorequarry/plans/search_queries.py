"""Lexical and vector queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import cells as C
from lorequarry.operators import lexical as L
from lorequarry.operators import selection as O
from lorequarry.operators import stored_index as X
from lorequarry.operators import vectors as V
from lorequarry.session import shared_folder, table

QUERY = "thand re tion thand schu ereau"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def words_sql(source: str, key: str, text: str) -> str:
    return f"SELECT {key} AS id, term FROM (SELECT {key}, lower(unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{Nd}}]{{2,}}'))) AS term FROM {source}) WHERE term NOT IN {STOP_SQL}"


def bm25_sql(chunks: str, n_docs: str, df: str) -> str:
    return f"""
words AS ({words_sql(chunks, "doc_id", "text")}),
p AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
dl AS (SELECT d.doc_id AS id, count(w.term) AS dl FROM {chunks} d LEFT JOIN words w ON w.id = d.doc_id GROUP BY 1),
df AS ({df}),
q AS (SELECT term, count(*) AS qtf FROM ({words_sql(f"(SELECT 0 AS k, '{QUERY}' AS t)", "k", "t")}) GROUP BY 1),
fig AS (SELECT ({n_docs}) AS n, (SELECT avg(dl) FROM dl) AS avgdl),
s AS (SELECT p.id, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1.0e0) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) * qtf) AS score
      FROM p JOIN q ON p.term = q.term JOIN df ON df.term = p.term JOIN dl ON dl.id = p.id CROSS JOIN fig GROUP BY 1)
"""


BY_DOC = "WITH " + bm25_sql("documents", "SELECT count(*) FROM documents", "SELECT term, count(DISTINCT id) AS df FROM p GROUP BY 1")
BY_SOURCE = "WITH " + bm25_sql("documents", "SELECT count(DISTINCT source) FROM documents", "SELECT term, count(DISTINCT source) AS df FROM p JOIN documents d ON d.doc_id = p.id GROUP BY 1")


def docs(s, d):
    return table(s, d, "documents")


def query_row(s):
    return s.createDataFrame([(QUERY,)], "query string")


def _bm25(s, d, document=None):
    return L.top(L.search(docs(s, d), query_row(s), document_col=document), 30).select("id", F.round("score", 6).alias("score"))


def vecs(s, d):
    return table(s, d, "embeddings")


def vector(s, d, i):
    return [float(x) for x in vecs(s, d).where(F.col("vec_id") == i).first()["embedding"]]


DIST = "1.0e0 - list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = {i})"
KNN = "SELECT vec_id, round(" + DIST.format(a="embedding", b=Q0) + ", 6) + 0.0e0 AS score FROM embeddings {where} ORDER BY round(" + DIST.format(a="embedding", b=Q0) + ", 9), vec_id LIMIT {k}"


def _r(df, *names):
    return df.select(*names, (F.round("score", 6) + 0.0).alias("score"))  # no negative zero


def _asked(s, d):
    """The stated queries of batch searches: every id divisible by 20."""
    return vecs(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _batch(s, d):
    return V.knn_batch(vecs(s, d), _asked(s, d), 10)


BATCH = "SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, " + DIST.format(a="v.embedding", b="q.embedding") + " AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(" + DIST.format(a="v.embedding", b="q.embedding") + ", 9), v.vec_id) AS INTEGER) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0) WHERE rank <= 10"
FIRST = "k AS (SELECT vec_id, embedding, " + DIST.format(a="embedding", b=Q0.format(i=0)) + " AS score FROM embeddings ORDER BY round(" + DIST.format(a="embedding", b=Q0.format(i=0)) + ", 9), vec_id LIMIT 15)"
CENTRE = "m AS (SELECT i, sum(embedding[i]::DOUBLE / (score + 0.01e0)) / sum(1.0e0 / (score + 0.01e0)) AS m FROM k, range(1, 65) r(i) GROUP BY 1), n AS (SELECT sqrt(sum(m * m)) AS n FROM m)"


def _first(s, d):
    e = vecs(s, d)
    return V.knn(e, vector(s, d, 0), 15).drop("rank").join(e.select("vec_id", "embedding"), "vec_id")


def _cells(s, d):
    """A persisted index of all embeddings."""
    return C.build(s, f"{shared_folder(s)}/cells-{uuid.uuid4().hex}", vecs(s, d))


def _kept_up(s, d):
    """A stored index that took all documents in three changes: those of a language come late, those of another go and come back."""
    lang, rows = F.coalesce("lang", F.lit("")), docs(s, d).select(F.col("doc_id").alias("id"), "text", "lang")
    index = X.open_index(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
    index = X.change(index, add=rows.where(lang != "fr"))
    index = X.change(index, add=rows.where(lang == "fr"), remove=rows.where(lang == "de"))
    index = X.change(index, add=rows.where(lang == "de"))
    return X.compact(index)


QUERIES = {
    "flt5_path_regex": (lambda s, d: table(s, d, "pages").where(F.col("url").rlike("(?i)/EN/[0-9]*5")).select("page_id"), "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)/EN/[0-9]*5')"),
    "flt6_path_prefix": (lambda s, d: table(s, d, "pages").where(F.lower("url").startswith("https://th")).select("page_id"), "SELECT page_id FROM pages WHERE starts_with(lower(url), 'https://th')"),
    "flt7_ordered_lookup": (
        lambda s, d: s.createDataFrame([(0, 5), (1, 999999999), (2, 3)], "pos int, id long").join(docs(s, d).select(F.col("doc_id").alias("id"), "source"), "id", "left").select("pos", "id", "source"),
        "SELECT CAST(pos AS INTEGER) AS pos, CAST(id AS BIGINT) AS id, source FROM (VALUES (0, 5), (1, 999999999), (2, 3)) v(pos, id) LEFT JOIN documents ON doc_id = id",
    ),
    "flt8_stop_words": (lambda s, d: docs(s, d).select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n")), f"SELECT doc_id, count(term) AS n FROM documents LEFT JOIN ({words_sql('documents', 'doc_id', 'text')}) ON id = doc_id GROUP BY 1"),
    "flt14_not_blank": (lambda s, d: docs(s, d).where(F.length(F.trim("text")) > 0).select("doc_id"), "SELECT doc_id FROM documents WHERE length(trim(text)) > 0"),
    "lx1_term_frequencies": (lambda s, d: L.term_frequencies(docs(s, d), "doc_id", "text"), f"SELECT id, term, count(*) AS tf FROM ({words_sql('documents', 'doc_id', 'text')}) GROUP BY ALL"),
    "lx2_unique_terms": (lambda s, d: docs(s, d).select("doc_id", F.size(F.array_distinct(T.terms(F.col("text")))).cast("long").alias("n")), f"SELECT doc_id, count(DISTINCT term) AS n FROM documents LEFT JOIN ({words_sql('documents', 'doc_id', 'text')}) ON id = doc_id GROUP BY 1"),
    "lx3_index_lengths": (lambda s, d: L.build_index(docs(s, d), "doc_id", "text").lengths, BY_DOC + "SELECT id, dl FROM dl"),
    "lx4_bm25_topk": (lambda s, d: _bm25(s, d, "source"), BY_SOURCE + "SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 30"),
    "lx5_memory_bm25": (lambda s, d: _bm25(s, d), BY_DOC + "SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 30"),
    "lx6_incremental_df": (
        lambda s, d: L.apply_delta(L.build_index(docs(s, d).where("doc_id % 3 <> 0"), "doc_id", "text").frequencies, docs(s, d).where("doc_id % 3 <> 1").withColumn("sign", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(-1)), "doc_id", "text", "sign"),
        f"SELECT term, count(DISTINCT id) AS df FROM ({words_sql('documents', 'doc_id', 'text')}) WHERE id % 3 <> 2 GROUP BY 1",
    ),
    "ag20_stored_index": (lambda s, d: L.top(X.search(_kept_up(s, d), QUERY), 30).select("id", F.round("score", 6).alias("score")), BY_DOC + "SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 30"),
    "ag20_kept_frequencies": (lambda s, d: _kept_up(s, d).frequencies(), BY_DOC + "SELECT term, df FROM df"),
    "ag6_document_frequency": (lambda s, d: L.build_index(docs(s, d), "doc_id", "text", "source").frequencies, BY_SOURCE + "SELECT term, df FROM df"),
    "ag7_chunk_frequency": (lambda s, d: L.build_index(docs(s, d), "doc_id", "text").postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), BY_DOC + "SELECT term, count(*) AS n FROM p GROUP BY 1"),
    "ag8_average_length": (lambda s, d: L.build_index(docs(s, d), "doc_id", "text").figures.select("documents", F.round("average", 6).alias("average")), BY_DOC + "SELECT n AS documents, round(avgdl, 6) AS average FROM fig"),
    "jn4_postings_probe": (lambda s, d: L.build_index(docs(s, d), "doc_id", "text").postings.join(F.broadcast(query_row(s).select(F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))), "term").select("term", "id", "tf"), BY_DOC + "SELECT p.term, p.id, tf FROM p JOIN q ON q.term = p.term"),
    "vc1_distances": (lambda s, d: _r(vecs(s, d).select("vec_id", V.distance(F.col("embedding"), F.array(*[F.lit(x) for x in vector(s, d, 7)])).alias("score")), "vec_id"), "SELECT vec_id, round(" + DIST.format(a="embedding", b=Q0.format(i=7)) + ", 6) + 0.0e0 AS score FROM embeddings"),
    "vc2_sanitised_norm": (
        lambda s, d: vecs(s, d).select("vec_id", F.round(F.get(V.sanitised(F.transform("embedding", lambda x: x * 3)), F.lit(0)), 6).alias("first")),
        "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
    ),
    "vc3_exact_knn": (lambda s, d: _r(V.knn(vecs(s, d), vector(s, d, 3), 10), "vec_id"), KNN.format(i=3, where="", k=10)),
    "flt9_filtered_knn": (lambda s, d: _r(V.knn(vecs(s, d), vector(s, d, 3), 10, F.col("label") == 4), "vec_id"), KNN.format(i=3, where="WHERE label = 4", k=10)),
    "vc6_knn_after_removal": (
        lambda s, d: _r(V.knn(V.live_vectors(vecs(s, d), vecs(s, d).where("vec_id = 1"), vecs(s, d).where("vec_id % 2 = 0").select("vec_id")), vector(s, d, 3), 10), "vec_id"),
        KNN.format(i=3, where="WHERE vec_id % 2 = 1", k=10),
    ),
    "vc7_batch_knn": (lambda s, d: _r(_batch(s, d), "query_id", "vec_id", "rank"), f"SELECT query_id, vec_id, rank, round(score, 6) + 0.0e0 AS score FROM ({BATCH})"),
    "vc8_second_page": (lambda s, d: _r(V.knn(vecs(s, d), vector(s, d, 3), 10, without=V.knn(vecs(s, d), vector(s, d, 3), 10)), "vec_id"), KNN.format(i=3, where="WHERE vec_id NOT IN (SELECT vec_id FROM (" + KNN.format(i=3, where="", k=10) + "))", k=10)),
    "ag11_centroid": (
        lambda s, d: V.centroid(_first(s, d)).select(F.posexplode("centre").alias("i", "x")).select("i", F.round("x", 6).alias("x")),
        f"WITH {FIRST}, {CENTRE} SELECT CAST(i - 1 AS INTEGER) AS i, round(m / n, 6) AS x FROM m CROSS JOIN n",
    ),
    "ag12_median_mad": (
        lambda s, d: O.median_and_mad(table(s, d, "documents"), "n_chars"),
        "SELECT median(n_chars) AS median, (SELECT median(abs(n_chars - (SELECT median(n_chars) FROM documents))) FROM documents) AS mad FROM documents",
    ),
    "vc4_cell_search": (lambda s, d: _r(C.search_batch(_cells(s, d), _asked(s, d), 10), "query_id", "vec_id", "rank"), None),
    "vc4_cell_recall": (lambda s, d: V.recall(C.search_batch(_cells(s, d), _asked(s, d), 10), _batch(s, d)), None),
    "ag18_recall": (lambda s, d: V.recall(_batch(s, d), V.knn_by_pairs(vecs(s, d), _asked(s, d), 10)), None),
    "jn3_new_ids": (lambda s, d: docs(s, d).join(vecs(s, d), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "jn12_reconcile": (
        lambda s, d: docs(s, d).where("doc_id % 7 <> 0").select("doc_id").join(vecs(s, d).select("vec_id"), F.col("doc_id") == F.col("vec_id"), "full_outer").where("doc_id IS NULL OR vec_id IS NULL").select("doc_id", "vec_id"),
        "SELECT doc_id, vec_id FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) d FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL",
    ),
    "so1_except": (lambda s, d: docs(s, d).select("source").subtract(docs(s, d).where("doc_id < 10").select("source")), "SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id < 10"),
    "so2_intersect": (lambda s, d: docs(s, d).where("lang = 'de'").select("source").intersect(docs(s, d).where("lang = 'fr'").select("source")), "SELECT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'fr'"),
    "so3_union_of_sets": (lambda s, d: docs(s, d).select(F.explode(F.array_union(F.array("lang"), F.array("source"))).alias("v")).distinct(), "SELECT lang AS v FROM documents UNION SELECT source FROM documents"),
    "so4_bag_union": (lambda s, d: docs(s, d).select("lang").unionAll(docs(s, d).where("doc_id < 9").select("lang")).groupBy("lang").count().withColumnRenamed("count", "n"), "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents WHERE doc_id < 9) GROUP BY 1"),
}
