"""Queries on Markdown nodes, references, chunks and dependency tables, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import context as X
from lorequarry.operators import control as K
from lorequarry.operators import files as P
from lorequarry.operators import hybrid as H
from lorequarry.operators import markdown as M
from lorequarry.operators import snippets as S
from lorequarry.plans.context_queries import PATH, paths
from lorequarry.plans.search_queries import docs, query_row
from lorequarry.session import kept, table


def notes(s, d):
    """documents as Markdown files: a heading, a tag, the text and a list."""
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit("# Doc "), n, F.lit("\n\n[def d"), n, F.lit("] [dependsOn src1/"), (F.col("doc_id") + 20).cast("string"), F.lit(".md]\n\n"), "text", F.lit("\n\n- one\n- two\n"))
    return docs(s, d).select(F.concat("source", F.lit("/"), n, F.lit(".md")).alias("path"), body.alias("content"))


def nodes(s, d):
    """The nodes of the notes, parsed once for all that reads them."""
    return kept(M.parse(notes(s, d)))


def _context(s, d):
    n = nodes(s, d)
    return X.fetch_context(_requests(s, d), notes(s, d), n, M.tags(n, "def")).select("request", "path", "start", F.col("end").alias("end_"), F.array_join("refs", "|").alias("refs"), "text")


def _broken(s, d):
    n = nodes(s, d)
    return M.broken_references(M.tags(n, "dependsOn").select("path", F.col("value").alias("ref")), notes(s, d).select("path"), M.tags(n, "def"))


def _chunk_sync(s, d):
    """All chunks against those of a snapshot without the files of one folder; chunks of a file depend on that file alone."""
    now = kept(M.chunks(nodes(s, d)).select("path", "hash"))
    return M.sync(now, now.where("path NOT LIKE 'src1/%'")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def references(s, d):
    return paths(s, d).select("page_id", F.element_at(F.array(F.col("path"), F.concat("path", F.lit("/")), F.concat("path", F.lit(".md")), F.concat("path", F.lit(".md@Intro")), F.concat("path", F.lit(":10,25"))), (F.col("page_id") % 5 + 1).cast("int")).alias("ref"))


def _ref(s, d):
    return references(s, d).select("page_id", M.parse_reference(F.col("ref")).alias("r")).select("page_id", "r.kind", "r.path", "r.definition", "r.start", F.col("r.end").alias("end_"))


UNITS = ["second", "minutes", "hour", "days", "week", "months", "YEAR"]


def _date_words():
    """Orders as dates in words: now, today, yesterday, the date of the order, or so many units ago."""
    k, i = F.pmod(F.col("o_orderkey"), F.lit(11)).cast("int"), F.pmod(F.col("o_orderkey"), F.lit(41)).cast("string")
    ago = F.concat(F.lit(" "), i, F.lit(" "), F.get(F.array(*[F.lit(u) for u in UNITS]), k - 4), F.lit(" ago"))
    return F.when(k == 0, "now").when(k == 1, "Today").when(k == 2, "yesterday ").when(k == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(ago)


def _plugins(s, d):
    """Documents as plugins: each depends on the one of half its number, softly for the threes, and some on one that is missing."""
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "optional").otherwise("hard")
    both = F.array_compact(F.array(F.when(i > 0, F.struct(F.concat(F.lit("d"), F.floor(i / 2).cast("string")).alias("on"), kind.alias("kind"))), F.when(i % 100 == 55, F.struct(F.lit("none").alias("on"), F.lit("hard").alias("kind")))))
    return docs(s, d).select(F.concat(F.lit("d"), i.cast("string")).alias("plugin"), F.explode_outer(both).alias("e")).select("plugin", F.col("e.on").alias("depends_on"), "e.kind").distinct()

QUERIES = {
    "md1_parse": (lambda s, d: M.parse(notes(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), None),
    "md10_tags": (lambda s, d: M.tags(M.parse(notes(s, d)), "def").select("path", "value"), "SELECT source || '/' || doc_id::VARCHAR || '.md' AS path, 'd' || doc_id::VARCHAR AS value FROM documents"),
    "md12_parse_reference": (
        _ref,
        f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN CASE WHEN regexp_matches(p, '(^|/)[^/]+\\.[^/.]+$') THEN 'File' ELSE 'Directory' END WHEN 1 THEN 'Directory' WHEN 2 THEN CASE WHEN ends_with(p, '/') THEN 'Directory' ELSE 'File' END WHEN 3 THEN 'Definition' ELSE 'Offsets' END AS kind,
        CASE WHEN page_id % 5 IN (2, 3) THEN p || '.md' WHEN page_id % 5 = 1 THEN p || '/' ELSE p END AS path, CASE WHEN page_id % 5 = 3 THEN 'Intro' END AS definition, CASE WHEN page_id % 5 = 4 THEN 10 END AS start, CASE WHEN page_id % 5 = 4 THEN 25 END AS end_
        FROM (SELECT page_id, {PATH} AS p FROM pages)""",
    ),
    "md13_file_and_directory": (
        lambda s, d: references(s, d).select("page_id", M.parse_reference(F.col("ref")).alias("r")).select("page_id", M.reference_file(F.col("r")).alias("file"), M.reference_directory(F.col("r")).alias("directory")),
        f"""SELECT page_id, CASE WHEN page_id % 5 = 4 OR page_id % 5 = 0 AND regexp_matches(p, '(^|/)[^/]+\\.[^/.]+$') THEN p WHEN page_id % 5 = 3 OR page_id % 5 = 2 AND NOT ends_with(p, '/') THEN p || '.md' END AS file,
        CASE WHEN page_id % 5 = 1 THEN p || '/' WHEN page_id % 5 = 0 AND NOT regexp_matches(p, '(^|/)[^/]+\\.[^/.]+$') THEN p WHEN page_id % 5 = 2 AND ends_with(p, '/') THEN p || '.md' ELSE regexp_extract(p, '^(.*/)', 1) END AS directory
        FROM (SELECT page_id, {PATH} AS p FROM pages)""",
    ),
    "md11_unresolved_local": (
        lambda s, d: M.unresolved_local(docs(s, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("@d"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string")).alias("ref")), M.tags(M.parse(notes(s, d)), "def")),
        "SELECT source || '/' || doc_id::VARCHAR || '.md' AS path, '@d' || (doc_id - 1)::VARCHAR AS ref FROM documents WHERE doc_id % 2 = 1",
    ),
    "df2_fetch_context": (
        _context,
        None,
    ),
    "jn13_unshown_blocks": (lambda s, d: X.unshown_blocks(_markers(s, d)), None),
    "jn7_broken_references": (
        _broken,
        "SELECT source || '/' || doc_id::VARCHAR || '.md' AS path, 'src1/' || (doc_id + 20)::VARCHAR || '.md' AS ref FROM documents WHERE 'src1/' || (doc_id + 20)::VARCHAR || '.md' NOT IN (SELECT source || '/' || doc_id::VARCHAR || '.md' FROM documents)",
    ),
    "ck2_chunks": (lambda s, d: M.chunks(nodes(s, d)).select("path", "node_id", "chunk", "hash"), None),
    "ck7_chunk_sync": (_chunk_sync, None),
    "df1_fetch": (
        lambda s, d: M.fetch(notes(s, d), M.parse(notes(s, d)), docs(s, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md:2,60")).alias("ref"))),
        "SELECT source || '/' || doc_id::VARCHAR || '.md:2,60' AS ref, substr('# Doc ' || doc_id::VARCHAR || chr(10) || chr(10) || '[def d' || doc_id::VARCHAR || '] [dependsOn src1/' || (doc_id + 20)::VARCHAR || '.md]' || chr(10) || chr(10) || text || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10), 3, 58) AS text FROM documents",
    ),
    "hy9_bounding_trees": (lambda s, d: H.bounding_trees(_hits(s, d), _nodes(s, d)).select("root", "hits", F.round("mean", 6).alias("mean"), "chars"), "SELECT doc_id // 10 + 1 AS root, count(*) AS hits, round(avg(1.0e0 / (doc_id + 1)), 6) AS mean, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"),
    "hy11_snippets": (lambda s, d: S.snippets(docs(s, d).select(F.col("doc_id").alias("id"), "text"), query_row(s)), None),
    "ud5_dependency_levels": (
        lambda s, d: K.dependency_levels(_plugins(s, d).select("plugin").distinct(), _plugins(s, d).where("depends_on is not null").select("plugin", "depends_on", "kind")),
        # a plugin is loadable unless it or one that it hangs on lacks a hard dependency: the fives of each hundred do
        """WITH RECURSIVE p AS (SELECT doc_id AS i, doc_id // 2 AS up, doc_id % 3 = 0 AS soft FROM documents),
        e AS (SELECT i, up, soft FROM p WHERE i > 0 UNION ALL SELECT i, -1, false FROM p WHERE i % 100 = 55),
        bad AS (SELECT i FROM e WHERE NOT soft AND up NOT IN (SELECT i FROM p) UNION SELECT e.i FROM e JOIN bad ON e.up = bad.i WHERE NOT e.soft),
        ok AS (SELECT i FROM p WHERE i NOT IN (SELECT i FROM bad)),
        lv AS (SELECT i, 0 AS level FROM ok UNION SELECT e.i, lv.level + 1 FROM e JOIN lv ON e.up = lv.i WHERE e.i IN (SELECT i FROM ok))
        SELECT 'd' || i AS plugin, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY 1""",
    ),
    "sf10_coerced_arguments": (
        lambda s, d: table(s, d, "part").select("p_partkey", K.coerced(F.col("p_size").cast("string"), "int").alias("i"), K.coerced(F.col("p_name"), "number").alias("x"), K.coerced(F.col("p_type"), "enum", ("economy", "small")).alias("e")),
        "SELECT p_partkey, p_size::BIGINT AS i, TRY_CAST(p_name AS DOUBLE) AS x, CASE WHEN lower(p_type) IN ('economy', 'small') THEN lower(p_type) END AS e FROM part",
    ),
    "sf6_short_hash": (lambda s, d: docs(s, d).select("doc_id", F.left(F.sha2("text", 256), F.lit(7)).alias("short"), F.substring_index("text", "\n", 1).alias("line")), "SELECT doc_id, left(sha256(text), 7) AS short, split_part(text, chr(10), 1) AS line FROM documents"),
    "sf3_distance_text": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.distance_text(F.col("p_partkey") * 24.0).alias("t"), T.compact_number(F.col("p_partkey") * 250.0).alias("c")),
        "SELECT p_partkey, CASE WHEN p_partkey * 24 < 1000 THEN (p_partkey * 24)::VARCHAR || ' m' ELSE regexp_replace(printf('%.2f', p_partkey * 24 / 1000.0e0), '\\.?0+$', '') || ' km' END AS t, CASE WHEN p_partkey * 250 >= 1000000 THEN regexp_replace(printf('%.2f', p_partkey * 250 / 1e6), '\\.?0+$', '') || 'M' WHEN p_partkey * 250 >= 1000 THEN regexp_replace(printf('%.2f', p_partkey * 250 / 1e3), '\\.?0+$', '') || 'K' ELSE (p_partkey * 250)::VARCHAR END AS c FROM part",
    ),
    "cd6_relative_dates": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", T.relative_date(_date_words(), F.lit("2024-06-10 12:00:00").cast("timestamp")).cast("timestamp_ntz").alias("moment")),
        """SELECT o_orderkey, CASE k WHEN 0 THEN n WHEN 1 THEN TIMESTAMP '2024-06-10' WHEN 2 THEN TIMESTAMP '2024-06-09' WHEN 3 THEN o_orderdate::TIMESTAMP
          ELSE n - to_seconds((i * [1, 60, 3600, 86400, 604800, 2592000, 31536000][k - 3])::DOUBLE) END AS moment
        FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 11 AS k, o_orderkey % 41 AS i, TIMESTAMP '2024-06-10 12:00:00' AS n FROM orders)""",
    ),
    "cd7_nth_ancestor": (
        lambda s, d: P.nth_ancestor(table(s, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("sha"), F.when(F.col("n_nationkey") > 0, F.concat(F.lit("c"), (F.col("n_nationkey") - 1).cast("string"))).alias("parent")), "c20", 4),
        "SELECT 'c16' AS sha",
    ),
}


def _nodes(s, d):
    """A two-level tree over documents: a folder for each ten documents under one root."""
    leaf = docs(s, d).select((F.col("doc_id") + 1_000_000).alias("node_id"), (F.floor(F.col("doc_id") / 10) + 1).alias("parent_id"), F.lit(2).alias("depth"), F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"))
    leaf = leaf.withColumn("ancestors", F.array(F.lit(0).cast("long"), "parent_id"))
    folder = leaf.groupBy(F.col("parent_id").alias("node_id")).agg(F.lit(0).cast("long").alias("parent_id"), F.lit(1).alias("depth"), F.lit(0).cast("long").alias("start"), F.sum("end").alias("end")).withColumn("ancestors", F.array(F.lit(0).cast("long")))
    root = s.createDataFrame([(0, None, 0, 0, 0, [])], "node_id long, parent_id long, depth int, start long, end long, ancestors array<long>")
    return leaf.unionByName(folder).unionByName(root)


def _hits(s, d):
    return docs(s, d).select((F.col("doc_id") + 1_000_000).alias("node_id"), (1.0 / (F.col("doc_id") + 1)).alias("score"))


def _requests(s, d):
    """Three references into each file; a request asks for those of four files."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    refs = F.array(F.concat(path, F.lit(":2,4")), F.concat(path, F.lit("@d"), F.col("doc_id").cast("string")), F.concat(path, F.lit(":60,70")))
    return docs(s, d).select(F.floor(F.col("doc_id") / 4).alias("request"), F.explode(refs).alias("ref"))


def _markers(s, d):
    """All nodes but the documents, as shown in conversations of about twenty files each, whatever their number, in a mixed order."""
    n = M.parse(notes(s, d)).where("depth > 0")
    conv = F.pmod(F.xxhash64("path"), F.lit(max(1, docs(s, d).count() // 20))).alias("conv")
    order = F.row_number().over(Window.partitionBy(conv).orderBy(F.xxhash64("path", "node_id"), "path", "node_id")).cast("long")
    return n.select(conv, order.alias("pos"), "path", "node_id", "start", "end", "ancestors")
