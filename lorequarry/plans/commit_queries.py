"""Queries on a commit graph made of the events: a long first-parent line, with a branch in each ten that is merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.operators import commits as G
from lorequarry.session import cut, table


def _sha(i):
    return F.sha1(i.cast("string"))


def commits(s, d):
    """Commit n follows n - 1, but in each ten the sixth branches off the second and is merged by the seventh."""
    i, place = F.col("event_id"), F.pmod(F.col("event_id"), F.lit(10))
    first = F.when(place == 5, i - 4).when(place == 6, i - 2).otherwise(i - 1)
    parents = F.when(i == 0, F.array().cast("array<string>")).when(place == 6, F.array(_sha(first), _sha(i - 1))).otherwise(F.array(_sha(first)))
    e = table(s, d, "events").where("event_id is not null")
    return e.select(_sha(i).alias("sha"), parents.alias("parents"), F.col("event_type").alias("author"), F.col("ts").cast("timestamp").alias("time"), F.col("props").alias("message"), "event_id", "user_id")


def changes(s, d):
    status = F.get(F.array(*[F.lit(x) for x in "ADMR"]), F.pmod(F.col("event_id"), F.lit(4)).cast("int"))
    e = table(s, d, "events").where("event_id is not null")
    path = F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"), F.lit("/f"), F.col("user_id").cast("string"))
    return e.select(_sha(F.col("event_id")).alias("sha"), path.alias("path"), status.alias("status"), F.floor("value").alias("added"), (F.col("event_id") % 3).alias("deleted"))


def graph(s, d):
    return G.Graph(cut(commits(s, d).select("sha", "parents")))


def _refs(s, d):
    """HEAD is the first commit of the last ten, base that of the middle."""
    last = table(s, d, "events").agg(F.max("event_id").alias("n"))
    ids = last.select(F.explode(F.array(F.struct(F.lit("HEAD").alias("name"), (F.floor(F.col("n") / 10) * 10).alias("i")), F.struct(F.lit("base").alias("name"), (F.floor(F.col("n") / 20) * 10).alias("i")))).alias("r"))
    return ids.select("r.name", _sha(F.col("r.i")).alias("sha"))


def _ancestors(s, d):
    asked = commits(s, d).select("event_id", "sha", (F.col("event_id") % 700).alias("hops"))
    return G.ancestors(graph(s, d), asked).select("event_id", "hops", "ancestor")


def _range(s, d):
    refs = _refs(s, d)
    return G.commit_range(graph(s, d), refs.where("name = 'base'"), refs.where("name = 'HEAD'"))


def _revisions(s, d):
    i = F.col("event_id")
    forms = F.array(F.concat(F.lit("HEAD~"), i.cast("string")), F.concat(F.lit("HEAD^"), (i % 50).cast("string")), F.concat(_sha(i), F.lit("~2")), F.concat(F.lit("base~"), (i % 9).cast("string"), F.lit("x")), F.concat(F.lit("nothing"), i.cast("string")))
    asked = commits(s, d).select(F.get(forms, F.pmod(i, F.lit(5)).cast("int")).alias("rev"))
    return G.rev_parse(graph(s, d), _refs(s, d), asked)


def _log(s, d):
    kept = G.log(commits(s, d), no_merges=True, since=F.lit("2024-01-05").cast("timestamp"), author="^(click|VIEW)$")
    return G.show(kept, changes(s, d), kept, statuses="AM", specs=("u1", "U3/", "u4/f4")).where("files > 0").select("sha", "author", F.unix_micros("time").alias("time"), "files", "added", "deleted", F.get("changes", F.lit(0))["path"].alias("path"))


def _status(s, d):
    rows = table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha1(F.coalesce("text", F.lit(""))).alias("hash"))
    head = rows.where("lang <> 'en'")
    index = rows.where("lang <> 'de'").select("path", F.when(F.col("lang") == "fr", F.sha1("hash")).otherwise(F.col("hash")).alias("hash"))
    work = rows.where("lang <> 'es'").select("path", "hash")
    return G.status(head, index, work).select("path", "staged", "unstaged", F.col("old").isNotNull().alias("renamed"))


LINE = "(9 * ({i} // 10) + CASE WHEN {i} % 10 > 5 THEN {i} % 10 - 1 ELSE {i} % 10 END)"  # place on the first-parent line
BACK = "(10 * ({p} // 9) + CASE WHEN {p} % 9 > 4 THEN {p} % 9 + 1 ELSE {p} % 9 END)"
HOP = f"CASE WHEN {{n}} = 0 THEN {{i}} WHEN {{i}} % 10 = 5 THEN {BACK.format(p='(' + LINE.format(i='({i} - 4)') + ' - ({n} - 1))')} ELSE {BACK.format(p='(' + LINE.format(i='{i}') + ' - {n})')} END"
DEEP = f"CASE WHEN {{i}} % 10 = 5 THEN {LINE.format(i='({i} - 4)')} + 1 ELSE {LINE.format(i='{i}')} END"


def ancestor_sql(i: str, n: str) -> str:
    return f"CASE WHEN {n} <= {DEEP.format(i=i)} THEN sha1(({HOP.format(i=i, n=n)})::VARCHAR) END"


QUERIES = {
    "cd7_nth_ancestors": (_ancestors, f"SELECT event_id, event_id % 700 AS hops, {ancestor_sql('event_id', '(event_id % 700)')} AS ancestor FROM events"),
    "cd5_commit_range": (
        _range,
        "WITH m AS (SELECT 10 * (max(event_id) // 10) AS b, 10 * (max(event_id) // 20) AS a FROM events) SELECT sha1(event_id::VARCHAR) AS sha FROM events, m WHERE CASE WHEN event_id % 10 = 5 THEN event_id + 1 > a AND event_id + 1 <= b ELSE event_id > a AND event_id <= b END",
    ),
    "cd5_rev_parse": (
        _revisions,
        f"""WITH m AS (SELECT 10 * (max(event_id) // 10) AS h FROM events),
        r AS (SELECT DISTINCT h, CASE event_id % 5 WHEN 0 THEN 'HEAD~' || event_id WHEN 1 THEN 'HEAD^' || event_id % 50 WHEN 2 THEN sha1(event_id::VARCHAR) || '~2' WHEN 3 THEN 'base~' || event_id % 9 || 'x' ELSE 'nothing' || event_id END AS rev,
          CASE event_id % 5 WHEN 0 THEN {ancestor_sql('h', 'event_id')} WHEN 1 THEN {ancestor_sql('h', '(event_id % 50)')} WHEN 2 THEN {ancestor_sql('event_id', '2')} END AS sha,
          CASE event_id % 5 WHEN 3 THEN 'malformed' WHEN 4 THEN 'unknown' END AS bad FROM events, m)
        SELECT rev, sha, coalesce(bad, CASE WHEN sha IS NULL THEN 'not enough parents' END) AS error FROM r""",
    ),
    "cd5_log_and_show": (
        _log,
        """SELECT sha1(event_id::VARCHAR) AS sha, event_type AS author, epoch_us(ts) AS time, CAST(1 AS BIGINT) AS files, floor(value)::BIGINT AS added, event_id % 3 AS deleted, 'u' || user_id % 7 || '/f' || user_id AS path
        FROM events WHERE event_id % 10 <> 6 AND ts >= TIMESTAMP '2024-01-05' AND event_type IN ('click', 'view') AND event_id % 4 IN (0, 2) AND (user_id % 7 IN (1, 3) OR user_id = 4)""",
    ),
    "cd5_status": (
        _status,
        """WITH r AS (SELECT coalesce(lang, '') AS lang, source || '/' || doc_id AS path, sha1(coalesce(text, '')) AS hash FROM documents),
        h AS (SELECT * FROM r WHERE lang <> 'en'), i AS (SELECT path, CASE WHEN lang = 'fr' THEN sha1(hash) ELSE hash END AS hash FROM r WHERE lang <> 'de'), w AS (SELECT * FROM r WHERE lang <> 'es'),
        s AS (SELECT coalesce(h.path, i.path) AS path, h.hash AS b, i.hash AS a, CASE WHEN h.hash IS NULL THEN 'A' WHEN i.hash IS NULL THEN 'D' ELSE 'M' END AS s FROM h FULL JOIN i ON i.path = h.path WHERE h.hash IS DISTINCT FROM i.hash),
        n AS (SELECT *, row_number() OVER (PARTITION BY s, coalesce(b, a) ORDER BY path) AS n FROM s WHERE s <> 'M'),
        v AS (SELECT x.path AS old, y.path AS path FROM n x JOIN n y ON x.s = 'D' AND y.s = 'A' AND x.b = y.a AND x.n = y.n),
        g AS (SELECT s.path, CASE WHEN v.old IS NULL THEN s ELSE 'R' END AS s, v.old FROM s LEFT JOIN v ON v.path = s.path WHERE s.path NOT IN (SELECT old FROM v)),
        u AS (SELECT coalesce(i.path, w.path) AS path, CASE WHEN i.hash IS NULL THEN '?' WHEN w.hash IS NULL THEN 'D' ELSE 'M' END AS u FROM i FULL JOIN w ON w.path = i.path WHERE i.hash IS DISTINCT FROM w.hash)
        SELECT coalesce(g.path, u.path) AS path, CASE WHEN u = '?' AND s IS NULL THEN '?' ELSE coalesce(s, ' ') END AS staged, coalesce(u, ' ') AS unstaged, old IS NOT NULL AS renamed FROM g FULL JOIN u ON u.path = g.path""",
    ),
}
