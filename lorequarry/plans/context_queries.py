"""Queries of hybrid retrieval, files, ranges, conversations and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import context as X
from lorequarry.operators import control as K
from lorequarry.operators import conversations as C
from lorequarry.operators import files as P
from lorequarry.operators import hybrid as H
from lorequarry.operators import lexical as L
from lorequarry.operators import vectors as V
from lorequarry.plans.search_queries import BY_DOC, CENTRE, DIST, FIRST, Q0, docs, query_row, vector, vecs, words_sql
from lorequarry.session import table
from lorequarry.streaming import bursts as B
from lorequarry.streaming import events as E

D0 = DIST.format(a="embedding", b=Q0.format(i=0))
NEAR = f"h AS (SELECT vec_id AS id, embedding, {D0} AS score, row_number() OVER (ORDER BY round({D0}, 9), vec_id) AS rank FROM embeddings QUALIFY rank <= 100)"
COHERENT = f"""
{NEAR}, {FIRST}, {CENTRE},
off AS (SELECT id, rank, 1.0e0 - sum(embedding[i]::DOUBLE * m / n) AS off FROM h, m, n GROUP BY ALL),
med AS (SELECT median(off) AS med FROM off WHERE rank <= 15),
mad AS (SELECT median(abs(off - med)) AS mad FROM off, med WHERE rank <= 15),
acc AS (SELECT id, off, row_number() OVER (ORDER BY rank) AS rank FROM off, med, mad WHERE off <= med + 1.0e0 * mad)
"""
LEX = "lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 30))"
RRF = "SELECT id, round(sum(1.0e0 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM acc UNION ALL SELECT id, rank FROM lex) GROUP BY 1"


def _near(s, d, k=100):
    e = vecs(s, d)
    return V.knn(e, vector(s, d, 0), k).join(e.select("vec_id", "embedding"), "vec_id").withColumnRenamed("vec_id", "id")


def flagship(s, d):
    """Hybrid retrieval over documents and embeddings: fused, best first."""
    fused = H.fast_context(docs(s, d), vecs(s, d), query_row(s), vector(s, d, 0), multiplier=1.0)
    return fused.select("id", F.round("score", 9).alias("score"))


def _gap(s, d):
    best = L.top(L.search(docs(s, d), query_row(s)), 30)
    results = best.join(docs(s, d), F.col("id") == F.col("doc_id")).select("id", "text")
    return H.gap_terms(results, query_row(s), 0.5).select("term", "n", F.round("p", 9).alias("p"))


PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def paths(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


def text_files(s, d):
    return docs(s, d).select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


LINES = "lines AS (SELECT source || '/' || doc_id::VARCHAR || '.txt' AS path, unnest(str_split(regexp_replace(text, '\\n$', ''), chr(10))) AS text, generate_subscripts(str_split(regexp_replace(text, '\\n$', ''), chr(10)), 1)::INTEGER AS line FROM documents)"


def ranges(s, d, shift=0):
    at = (F.col("doc_id") * 37 + shift) % 1000
    return docs(s, d).select(F.col("source").alias("doc"), at.alias("start"), (at + F.col("n_chars") % 25).alias("end"), F.col("lang").alias("label"))


RANGES = "(SELECT source AS doc, (doc_id * 37 + {shift}) % 1000 AS start, (doc_id * 37 + {shift}) % 1000 + n_chars % 25 AS end_, lang AS label FROM documents)"


def merged_sql(shift: int, gap: int) -> str:
    return f"""SELECT doc, min(start) AS start, max(end_) AS end_, list_sort(list(DISTINCT label)) AS labels FROM (
      SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start <= max(end_) OVER (PARTITION BY doc ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS opens
        FROM {RANGES.format(shift=shift)})) GROUP BY doc, island"""


def talk(s, d):
    return table(s, d, "conversations")


def acts(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 90).alias("len"), "event_id", "event_type")


SESSION_SQL = """SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, nth"""
HANDLERS = [("a", "click", 3, False, True), ("b", "click", 2, True, True), ("c", "click", 1, False, False), ("d", "view", 0, True, False), ("e", "view", -2, False, False), ("f", "error", 2, True, False), ("g", "error", 1, True, True), ("h", "error", -1, False, False)]
HANDLERS_SQL = "(VALUES " + ", ".join(f"('{h}', '{t}', {p}, {c}, {x})" for h, t, p, c, x in HANDLERS) + ") h(handler, event_type, priority, critical, fails)"


def handlers(s):
    return s.createDataFrame(HANDLERS, "handler string, event_type string, priority int, critical boolean, fails boolean")


QUERIES = {
    "hy2_nearest_hits": (lambda s, d: _near(s, d).select("id", "rank"), f"WITH {NEAR} SELECT id, CAST(rank AS INTEGER) AS rank FROM h"),
    "hy4_term_hits": (lambda s, d: L.top(L.search(docs(s, d), query_row(s)), 30).select("id", "rank"), BY_DOC + f", {LEX} SELECT id, CAST(rank AS INTEGER) AS rank FROM lex"),
    "hy6_coherent_hits": (lambda s, d: H.coherent(_near(s, d), 15, 1.0).select("id", "rank", F.round("off", 6).alias("off")), f"WITH {COHERENT} SELECT id, CAST(rank AS INTEGER) AS rank, round(off, 6) AS off FROM acc"),
    "hy8_rrf": (flagship, BY_DOC + f", {COHERENT}, {LEX} {RRF}"),
    "hy3_no_vector_hits": (lambda s, d: H.fast_context(docs(s, d), vecs(s, d).where("label > 99"), query_row(s), vector(s, d, 0)).select("id", "score"), "SELECT 0::BIGINT AS id, 0.0e0 AS score WHERE false"),
    "hy10_gap_terms": (
        _gap,
        BY_DOC + f", {LEX}, asked AS (SELECT DISTINCT term FROM q), cnt AS (SELECT a.term, count(p.id) AS n FROM asked a LEFT JOIN (SELECT p.term, p.id FROM p JOIN lex ON lex.id = p.id) p ON p.term = a.term GROUP BY 1), lam AS (SELECT avg(n) AS lam FROM cnt), pv AS (SELECT term, n, list_sum(list_transform(range(0, n + 1), lambda k: exp(-lam) * pow(lam, k) / gamma(k + 1))) AS p FROM cnt, lam) SELECT term, n, round(p, 9) AS p FROM pv WHERE p < 0.5",
    ),
    "hy13_memory_search": (
        lambda s, d: H.memory_search(docs(s, d), vecs(s, d), query_row(s), vector(s, d, 0), gate=F.col("n_chars") > 900).select("id", F.round("score", 9).alias("score")),
        BY_DOC + f", {NEAR}, v AS (SELECT id, rank FROM h WHERE rank <= 20), lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20), f AS (SELECT id, sum(1.0e0 / (60 + rank)) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM lx) GROUP BY 1 ORDER BY round(score, 12) DESC, id LIMIT 20) SELECT id, round(score, 9) AS score FROM f JOIN documents ON doc_id = id WHERE n_chars > 900 ORDER BY round(f.score, 12) DESC, id LIMIT 5",
    ),
    "hy14_namespace_search": (
        lambda s, d: H.memory_search(docs(s, d).where("source = 'src3'"), vecs(s, d).join(docs(s, d).where("source = 'src3'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), query_row(s), vector(s, d, 0)).select("id"),
        BY_DOC.replace("documents", "(SELECT * FROM documents WHERE source = 'src3')") + f", v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round({D0}, 9), vec_id) AS rank FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src3') QUALIFY rank <= 20), lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20) SELECT id FROM (SELECT id, sum(1.0e0 / (60 + rank)) AS f FROM (SELECT * FROM v UNION ALL SELECT * FROM lx) GROUP BY 1) ORDER BY round(f, 12) DESC, id LIMIT 5",
    ),
    "flt10_yes_gate": (
        lambda s, d: vecs(s, d).select("vec_id", H.yes_gate(F.when(F.col("vec_id") % 5 > 0, -F.col("label") / 4.0), 0.5).alias("relevant")),
        "SELECT vec_id, coalesce(exp(CASE WHEN vec_id % 5 > 0 THEN -label / 4.0e0 END), 0.0e0) >= 0.5e0 AS relevant FROM embeddings",
    ),
    "tk9_rerank": (lambda s, d: H.rerank(docs(s, d).withColumnRenamed("doc_id", "id"), F.col("n_chars") % 997, 15).select("id", "relevance"), "SELECT doc_id AS id, n_chars % 997 AS relevance FROM documents ORDER BY relevance DESC, id LIMIT 15"),
    "src2_normalised_paths": (lambda s, d: paths(s, d).select("page_id", P.normalised_path(F.concat(F.lit("/Data\\"), F.replace("path", F.lit("/"), F.lit("\\"))), "/data").alias("path")), f"SELECT page_id, {PATH} AS path FROM pages"),
    "df3_list_directory": (lambda s, d: P.list_directory(paths(s, d).select(F.regexp_replace("path", "^[^/]*/", "").alias("path")), ""), f"SELECT * FROM (SELECT DISTINCT CASE WHEN contains(p, '/') THEN 'dir' ELSE 'file' END AS kind, split_part(p, '/', 1) AS name FROM (SELECT regexp_replace({PATH}, '^[^/]*/', '') AS p FROM pages)) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY lower(name), name) <= 50"),
    "df4_find_files": (
        lambda s, d: P.find_files(paths(s, d), "/de/.*7").select("page_id", "path", "new_dir"),
        f"SELECT page_id, path, coalesce(dir <> lag(dir) OVER (ORDER BY lower(path), path), true) AS new_dir FROM (SELECT page_id, {PATH} AS path, regexp_replace({PATH}, '/?[^/]*$', '') AS dir FROM pages WHERE regexp_matches({PATH}, '(?i)/de/.*7') ORDER BY lower(path), path LIMIT 30)",
    ),
    "cd1_grep": (
        lambda s, d: P.grep(text_files(s, d), "idiot|moron"),
        f"WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n, count(*) OVER (PARTITION BY path) AS matches FROM lines WHERE regexp_matches(text, '(?i)idiot|moron')), b AS (SELECT DISTINCT path FROM f ORDER BY lower(path), path LIMIT 20) SELECT path, matches, line, CASE WHEN length(text) > 80 THEN left(text, 79) || '...' ELSE text END AS text FROM f SEMI JOIN b USING (path) WHERE n <= 5",
    ),
    "cd2_grep_context": (
        lambda s, d: P.grep_context(text_files(s, d), "idiot|moron", 1, 1).select("path", "line", "hit"),
        f"WITH {LINES}, m AS (SELECT *, regexp_matches(text, 'idiot|moron') AS hit FROM lines) SELECT path, line, hit FROM m QUALIFY max(hit::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1",
    ),
    "cd2_grep_inverted": (lambda s, d: P.grep_counts(text_files(s, d), "e", invert=True), f"WITH {LINES} SELECT path, count(*) AS n FROM lines WHERE NOT regexp_matches(text, '(?i)e') GROUP BY 1"),
    "cd3_read_lines": (lambda s, d: P.read_lines(text_files(s, d), 2, 4), f"WITH {LINES} SELECT path, line, CASE WHEN length(text) > 500 THEN left(text, 499) || '...' ELSE text END AS text FROM lines WHERE line BETWEEN 2 AND 4"),
    "wn11_head_tail": (lambda s, d: docs(s, d).select("doc_id", P.head_tail(F.col("text"), 3, 1).alias("t")), "SELECT doc_id, str_split(text, chr(10))[least(3, len(str_split(text, chr(10))))] AS t FROM documents"),
    "wn4_interval_merge": (lambda s, d: P.merged_ranges(ranges(s, d)).select("doc", "start", F.col("end").alias("end_"), F.array_join("labels", ",").alias("labels")), f"SELECT doc, start, end_, array_to_string(labels, ',') AS labels FROM ({merged_sql(0, 10)})"),
    "wn5_touching_merge": (lambda s, d: P.merged_ranges(ranges(s, d), 0).select("doc", "start", F.col("end").alias("end_")), f"SELECT doc, start, end_ FROM ({merged_sql(0, 0)})"),
    "jn9_uncovered_ranges": (
        lambda s, d: P.uncovered(ranges(s, d), ranges(s, d, 5)).select("doc", "start", F.col("end").alias("end_")),
        f"SELECT doc, start, end_ FROM {RANGES.format(shift=0)} r WHERE NOT EXISTS (SELECT 1 FROM ({merged_sql(5, 0)}) m WHERE m.doc = r.doc AND m.start <= r.start AND m.end_ >= r.end_)",
    ),
    "jn10_enclosing_block": (
        lambda s, d: P.enclosing_block(docs(s, d).select(F.col("source").alias("doc"), (F.col("doc_id") % 90).alias("s"), (F.col("doc_id") % 90 + 3).alias("e")), docs(s, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("node_id"), (F.col("doc_id") % 6).alias("depth"), (F.col("doc_id") % 6 * 10).alias("start"), (F.lit(120) - F.col("doc_id") % 6 * 10).alias("end"))),
        "SELECT p.doc, s, e, arg_min(node_id, (-depth, node_id)) AS node_id FROM (SELECT source AS doc, doc_id % 90 AS s, doc_id % 90 + 3 AS e FROM documents) p JOIN (SELECT source AS doc, doc_id AS node_id, doc_id % 6 AS depth, doc_id % 6 * 10 AS start, 120 - doc_id % 6 * 10 AS end_ FROM documents) n ON n.doc = p.doc AND start <= s AND end_ >= e GROUP BY ALL",
    ),
    "wn6_budget": (lambda s, d: P.within_budget(docs(s, d).select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), "text")), "SELECT source AS grp, doc_id AS pos, left(text, (8192 - coalesce(before, 0))::BIGINT) AS text FROM (SELECT *, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) WHERE coalesce(before, 0) < 8192"),
    "wn2_best_ranges": (lambda s, d: P.best_ranges(docs(s, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("start"), (F.col("n_chars") % 50).alias("score"))), "SELECT source AS doc, doc_id AS start, n_chars % 50 AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars % 50 DESC, doc_id) <= 3"),
    "aw1_edit_once": (lambda s, d: P.edit_once(docs(s, d).select(F.col("doc_id").alias("name"), F.col("text").alias("content")), "idiot", "friend"), "SELECT doc_id AS name, n::INTEGER AS matches, CASE WHEN n = 1 THEN replace(text, 'idiot', 'friend') ELSE text END AS content FROM (SELECT *, (length(text) - length(replace(text, 'idiot', ''))) // 5 AS n FROM documents)"),
    "aw3_artifact_list": (lambda s, d: text_files(s, d).select("path", F.length("content").alias("size"), (F.regexp_count("content", F.lit("\n")) + 1).alias("lines")), "SELECT source || '/' || doc_id::VARCHAR || '.txt' AS path, length(text)::INTEGER AS size, (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS lines FROM documents"),
    "aw5_safe_names": (lambda s, d: table(s, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name")), "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages"),
    "ck5_hard_split": (
        lambda s, d: docs(s, d).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.length("text"), F.lit(1)) / 1000).cast("int") - 1), lambda i: F.struct(i.alias("part"), F.substr(F.col("text"), i * 1000 + 1, F.lit(1000)).alias("chunk")))).alias("c")).select("doc_id", "c.part", "c.chunk"),
        "SELECT doc_id, part::INTEGER AS part, substr(text, (part * 1000 + 1)::BIGINT, 1000) AS chunk FROM documents, range(0, 1000) r(part) WHERE part * 1000 < greatest(length(text), 1)",
    ),
    "ck6_identity_hash": (lambda s, d: docs(s, d).select("doc_id", F.upper(F.sha2(F.concat_ws("\n", "source", F.col("doc_id").cast("string"), "text"), 256)).alias("hash")), "SELECT doc_id, upper(sha256(source || chr(10) || doc_id::VARCHAR || chr(10) || text)) AS hash FROM documents"),
    "ck7_sync_diff": (
        lambda s, d: docs(s, d).where("doc_id % 5 <> 0").select(F.sha2("text", 256).alias("h")).distinct().withColumn("now", F.lit(1)).join(docs(s, d).where("doc_id % 5 <> 1").select(F.sha2("text", 256).alias("h")).distinct().withColumn("was", F.lit(1)), "h", "full_outer").where("now IS NULL OR was IS NULL").select("h", F.when(F.col("was").isNull(), "add").otherwise("delete").alias("action")),
        "WITH n AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), w AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 5 <> 1) SELECT h, 'add' AS action FROM n WHERE h NOT IN (SELECT h FROM w) UNION ALL SELECT h, 'delete' FROM w WHERE h NOT IN (SELECT h FROM n)",
    ),
    "wn7_consumed": (lambda s, d: C.consumed(talk(s, d)).select("conv_id", "turn", "consumed"), "SELECT conv_id, turn, coalesce(max((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS consumed FROM conversations"),
    "sf13_compacted": (
        lambda s, d: C.compacted(talk(s, d), "user", 200).select("conv_id", "turn", "text"),
        "SELECT conv_id, turn, CASE WHEN role = 'user' AND c AND length(text) > 200 THEN CASE WHEN starts_with(text, '#') THEN regexp_extract(text, '^#[^\\n]*') || ' [' || length(text) || ' chars compacted]' ELSE '[Tool result compacted: ' || length(text) || ' chars]' END ELSE text END AS text FROM (SELECT *, coalesce(max((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS c FROM conversations)",
    ),
    "wn8_last_segment": (lambda s, d: C.last_segment(talk(s, d)).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations QUALIFY turn > max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id)"),
    "wn9_kept_parts": (
        lambda s, d: C.parts(talk(s, d)).select("conv_id", "turn", "part"),
        "SELECT conv_id, turn, CASE WHEN max((role <> 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn) = 0 THEN 'keep' WHEN role IN ('user', 'assistant') AND sum((role IN ('user', 'assistant'))::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= 4 THEN 'keep' ELSE 'summary' END AS part FROM conversations",
    ),
    "st10_eligible": (lambda s, d: C.eligible(talk(s, d)), "SELECT conv_id FROM conversations WHERE length(trim(text)) > 0 GROUP BY 1 HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')"),
    "sf11_chat_template": (lambda s, d: C.rendered(talk(s, d)), "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt FROM conversations GROUP BY 1"),
    "sf12_token_estimate": (lambda s, d: C.estimated_tokens(talk(s, d)), "SELECT conv_id, sum(ceil(length(text) / 4.0e0))::BIGINT AS tokens FROM conversations GROUP BY 1"),
    "sf1_gps": (
        lambda s, d: vecs(s, d).select("vec_id", T.parse_gps(F.when(F.col("vec_id") % 3 == 0, F.concat_ws(":", F.lit("GPS"), F.lit("n"), "label", "vec_id", F.lit("1.5"))).when(F.col("vec_id") % 3 == 1, F.concat_ws(":", "label", "vec_id", F.lit("2"))).otherwise(F.lit("1:2"))).alias("g")).select("vec_id", "g.x", "g.y", "g.z"),
        "SELECT vec_id, CASE WHEN vec_id % 3 < 2 THEN label::DOUBLE END AS x, CASE WHEN vec_id % 3 < 2 THEN vec_id::DOUBLE END AS y, CASE vec_id % 3 WHEN 0 THEN 1.5e0 WHEN 1 THEN 2.0e0 END AS z FROM embeddings",
    ),
    "sf5_truncate": (lambda s, d: docs(s, d).select("doc_id", T.truncated(F.col("text"), 80).alias("t")), "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 79) || '...' ELSE text END AS t FROM documents"),
    "sf7_line_at_offset": (lambda s, d: docs(s, d).select("doc_id", T.line_at(F.col("text"), 300).alias("line")), "SELECT doc_id, (length(left(text, 300)) - length(replace(left(text, 300), chr(10), '')) + 1)::INTEGER AS line FROM documents"),
    "sf8_poisson": (lambda s, d: vecs(s, d).select("vec_id", F.round(T.poisson_cdf(F.col("label"), F.lit(4.2)), 9).alias("p")), "SELECT vec_id, round(list_sum(list_transform(range(0, label + 1), lambda k: exp(-4.2e0) * pow(4.2e0, k) / gamma(k + 1))), 9) AS p FROM embeddings"),
    "sf10_json_arguments": (lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")), "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events"),
    "st3_sessions": (lambda s, d: E.sessions(acts(s, d), "30 minutes").select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n"), SESSION_SQL),
    "st7_dispatch": (
        lambda s, d: E.dispatched(acts(s, d).select("event_id", "event_type"), F.broadcast(handlers(s))),
        f"SELECT event_id, handler, priority::INTEGER AS priority, coalesce(max((critical AND fails)::INT) OVER (PARTITION BY event_id ORDER BY priority DESC, handler ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM events JOIN {HANDLERS_SQL} USING (event_type)",
    ),
    "st4_run_timeouts": (
        lambda s, d: E.run_timeouts(acts(s, d).select(F.col("key").alias("channel"), F.col("ts").alias("started"), (F.col("ts") + F.make_dt_interval(mins=(F.col("len") / 4).cast("int"))).alias("ended"), "event_id")).select("event_id", "timed_out", "refused"),
        "SELECT event_id, e > s + INTERVAL 14 MINUTE AS timed_out, coalesce(max(least(e, s + INTERVAL 14 MINUTE)) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s, false) AS refused FROM (SELECT *, ts AS s, ts + to_minutes((event_id % 90) // 4) AS e FROM events)",
    ),
    "st5_throttled": (lambda s, d: E.throttled(acts(s, d)).select("key", "total"), None),
    "st6_debounced": (
        lambda s, d: B.debounced(acts(s, d), 600_000).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "n"),
        """WITH RECURSIVE e AS (SELECT user_id AS key, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        u AS (SELECT DISTINCT key, ts FROM e),
        n AS (SELECT key, ts, min(ts) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM u),
        c AS (SELECT key, min(ts) AS ts FROM u GROUP BY 1 UNION ALL SELECT n.key, n.nxt FROM c JOIN n ON n.key = c.key AND n.ts = c.ts WHERE nxt IS NOT NULL)
        SELECT c.key, c.ts, count(*) AS n FROM c JOIN e ON e.key = c.key AND e.ts >= c.ts AND e.ts < c.ts + INTERVAL 600 SECOND GROUP BY 1, 2""",
    ),
    "flt11_log_filters": (
        lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01") & F.col("c_name").rlike("(?i)#0+1")).select("o_orderkey"),
        "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' AND regexp_matches(c_name, '(?i)#0+1')",
    ),
    "flt12_path_spec": (lambda s, d: paths(s, d).where(F.lower(F.regexp_replace("path", "^[^/]*/", "")).startswith("en/")).select("page_id"), f"SELECT page_id FROM pages WHERE starts_with(lower(regexp_replace({PATH}, '^[^/]*/', '')), 'en/')"),
    "flt13_status_filter": (lambda s, d: table(s, d, "lineitem").where(F.instr(F.lit("AR"), F.col("l_returnflag")) > 0).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE contains('AR', l_returnflag) GROUP BY 1"),
    "tk8_commit_limit": (lambda s, d: table(s, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40"),
    "wn1_positional_rank": (lambda s, d: docs(s, d).select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank")), "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents"),
    "wn3_groups_by_best": (
        lambda s, d: X.groups_by_best(docs(s, d), "source", "n_chars", 12),
        "SELECT source, max(n_chars) AS best, count(*) AS n, (SELECT greatest(count(DISTINCT source) - 12, 0) FROM documents) AS more FROM documents GROUP BY 1 ORDER BY best DESC, source LIMIT 12",
    ),
    "lx7_grep_content": (
        lambda s, d: X.grep_content(_chunked(s, d), query_row(s)).withColumnRenamed("end", "end_"),
        BY_DOC + """, r AS (SELECT source AS path, doc_id AS start, doc_id + n_chars AS end_, round(score, 9) AS score, replace(replace(CASE WHEN length(text) <= 60 THEN text ELSE left(text, 59) || '...' END, chr(13), ''), chr(10), ' ') AS snippet FROM s JOIN documents ON doc_id = id),
        f AS (SELECT path, max(score) AS best, count(*) AS n FROM r GROUP BY 1), b AS (SELECT * FROM f ORDER BY best DESC, path LIMIT 20)
        SELECT path, best, start, end_, snippet, greatest(n - 3, 0) AS more_ranges, (SELECT greatest(count(*) - 20, 0) FROM f) AS more_files FROM r JOIN b USING (path) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, start) <= 3""",
    ),
    "hy12_output": (
        lambda s, d: H.ordered_output(docs(s, d).select(F.col("source").alias("path"), F.col("doc_id").alias("root"), F.col("doc_id").alias("start"), (F.col("doc_id") + F.col("n_chars")).alias("end"), (1.0 / (F.col("doc_id") + 1)).alias("mean"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("heading"))).select("path", F.round("score", 9).alias("score"), "start", F.col("end").alias("end_"), "section", "too_much"),
        "SELECT source AS path, round(avg(1.0e0 / (doc_id + 1)) OVER (PARTITION BY source), 9) AS score, doc_id AS start, doc_id + n_chars AS end_, CASE WHEN doc_id % 2 = 0 THEN '@' || lang END AS section, (SELECT count(DISTINCT source) > 3 OR count(*) > 10 FROM documents) AS too_much FROM documents",
    ),
    "sf9_arithmetic": (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", K.evaluated(F.concat_ws("", F.lit("("), "l_partkey", F.lit(" + 0.5) * -"), "l_linenumber", F.lit(" ** 2"))).cast("decimal(30,1)").alias("x")),
        "SELECT l_orderkey, l_linenumber, CAST(CAST(l_partkey + 0.5 AS DECIMAL(20,1)) * -(l_linenumber * l_linenumber) AS DECIMAL(30,1)) AS x FROM lineitem",
    ),
    "aw6_attachments": (
        lambda s, d: table(s, d, "pages").select("page_id", K.attachment_errors(F.replace("url", F.lit("/"), F.when(F.col("page_id") % 2 == 0, "_").otherwise("/")), F.col("html"), 30, 900).alias("error")),
        "SELECT page_id, CASE WHEN page_id % 2 = 1 AND contains(url, '/') OR NOT regexp_matches(replace(url, '/', '_'), '^[A-Za-z0-9._-]+$') THEN 'name' WHEN length(url) > 30 THEN 'name length' WHEN length(html) > 900 THEN 'content length' END AS error FROM pages",
    ),
    "snk5_publishable": (
        lambda s, d: docs(s, d).select("doc_id", K.publishable(F.concat(F.repeat(F.lit("../"), (F.col("doc_id") % 3).cast("int")), "source", F.lit("/"), F.when(F.col("doc_id") % 2 == 0, "../").otherwise(""), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".txt").otherwise(".MD"))).alias("ok")),
        "SELECT doc_id, doc_id % 3 = 0 AND lang <> 'en' AS ok FROM documents",
    ),
}


def _chunked(s, d):
    """Every document as a chunk of a file for each source."""
    return docs(s, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), F.col("doc_id").alias("start"), (F.col("doc_id") + F.col("n_chars")).alias("end"), F.col("text").alias("raw"))
