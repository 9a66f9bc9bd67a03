"""Queries on logs that are folded in order, and on conversations that end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.session import table
from lorequarry.streaming import closing as C
from lorequarry.streaming import workspaces as W

QUOTAS = W.Quotas(files=3, each=1500, total=2500)


def workspace_log(s, d):
    """Conversations as logs of a workspace each: turns write, edit or delete files named after their roles."""
    c = table(s, d, "conversations").where("conv_id is not null")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    op = F.when(F.col("turn") % 5 == 4, "delete").when(F.col("turn") % 3 == 2, "edit").otherwise("write")
    name = F.concat(F.coalesce("role", F.lit("none")), F.lit("-"), (F.col("turn") % 4).cast("string"), F.when(F.col("turn") % 6 == 5, " ?").otherwise(".md"))
    edited = F.concat(F.coalesce("role", F.lit("none")), F.lit("-"), (F.col("turn") % 2).cast("string"), F.lit(".MD"))
    file = F.when(op == "write", name).otherwise(edited)
    return c.select(F.col("conv_id").cast("string").alias("workspace"), F.col("turn").alias("seq"), op.alias("op"), file.alias("name"), F.col("text").alias("content"), F.get(words, F.lit(0)).alias("find"), F.lit("…").alias("replacement"))


def event_turns(s, d):
    """Events as turns: a conversation for each user; purchases end it."""
    e = table(s, d, "events")
    role = F.when(F.col("event_type") == "purchase", C.END).otherwise(F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("conv"), "ts", role.alias("role"), F.col("event_id").cast("string").alias("text"))


def words_left():
    """A step that takes a line a turn, and fails on errors."""

    def step(text: str, turn: int) -> str:
        lines = text.split("\n")
        if lines[turn].startswith("error: ") and lines[turn].endswith("7"):
            raise ValueError(lines[turn])
        return C.DONE if turn + 1 == len(lines) else C.GO_ON

    return step


GAP = 1800
CLOSED_SQL = f"""
t AS (SELECT user_id::VARCHAR AS conv, ts, coalesce(CASE WHEN event_type = 'purchase' THEN 'end' ELSE event_type END, '') AS role, coalesce(event_id::VARCHAR, '') AS text FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, lag(ts) OVER w AS before, lag(role) OVER w AS mark FROM t WINDOW w AS (PARTITION BY conv ORDER BY ts, role = 'end', role, text)),
p AS (SELECT *, sum(CASE WHEN before IS NULL OR mark = 'end' OR epoch_us(ts) - epoch_us(before) >= {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY ts, role = 'end', role, text ROWS UNBOUNDED PRECEDING) AS part FROM l),
c AS (SELECT conv, part, min(ts) AS started, max(ts) AS ended, count(*) FILTER (role <> 'end') AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY ts, role, text) FILTER (role <> 'end') AS content, CASE WHEN bool_or(role = 'end') THEN 'ended' ELSE 'timeout' END AS reason
      FROM p GROUP BY 1, 2 HAVING count(*) FILTER (role <> 'end') > 0)"""
FAILS = "error: [0-9]*7$"

QUERIES = {
    "st9_closed_conversations": (
        lambda s, d: C.closed(event_turns(s, d), GAP).select("conv", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "turns", F.sha2("content", 256).alias("sha256"), "reason"),
        f"WITH {CLOSED_SQL} SELECT conv, epoch_us(started) AS started, epoch_us(ended) AS ended, turns, sha256(content) AS sha256, reason FROM c",
    ),
    "st1_worked_conversations": (
        lambda s, d: C.worked(C.closed(event_turns(s, d), GAP), "content", words_left, most_turns=50).select("conv", F.unix_micros("ended").alias("ended"), "steps", F.when(F.col("error").startswith("ValueError"), "failed").otherwise(F.col("error")).alias("error")),
        f"""WITH {CLOSED_SQL}, f AS (SELECT *, list_position(list_transform(str_split(content, chr(10)), lambda x: regexp_matches(x, '{FAILS}')), true) AS bad FROM c)
        SELECT conv, epoch_us(ended) AS ended, CAST(least(coalesce(bad, turns), 50) AS INTEGER) AS steps, CASE WHEN bad <= 50 THEN 'failed' WHEN turns > 50 THEN 'not done after 50 turns' END AS error FROM f""",
    ),
    "snk4_workspace_outcomes": (lambda s, d: W.outcomes(W.replayed(workspace_log(s, d), QUOTAS)), None),
    "aw4_workspace_files": (lambda s, d: W.files(W.replayed(workspace_log(s, d), QUOTAS)).select("workspace", "name", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("sha256")), None),
}
