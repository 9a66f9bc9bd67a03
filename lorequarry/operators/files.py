"""Operators on paths, lines and character ranges: listing, finding, grep, reading, interval merge, coverage, budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.operators.commits import Graph, ancestors
from lorequarry.functions.text import split_lines, truncated

# Directories that are never read.
IGNORED = (".git", ".vs", ".idea", "bin", "obj", "node_modules", "dist", "out", "__pycache__", ".venv")


def normalised_path(path: Column, root: str = "") -> Column:
    """Backslashes to slashes, the root prefix off (any case), no slash in front."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.ltrim(F.regexp_replace(p, "(?i)^" + re.escape(root.replace("\\", "/")), ""), F.lit("/"))


def readable_files(files: DataFrame, most_bytes: int = 5 << 20) -> DataFrame:
    """(path, content) without ignored directories, binary content (a NUL) and files above the size."""
    parts = "|".join(re.escape(d) for d in IGNORED)
    return files.where(~F.col("path").rlike(f"(?i)(^|/)({parts})/") & (F.instr("content", "\0") == 0) & (F.octet_length("content") <= most_bytes))


def sandboxed(path: str) -> str:
    """A relative path that stays inside its root, normalised; raises ValueError for rooted and escaping ones."""
    p = path.replace("\\", "/")
    if p.startswith("/") or re.match(r"^[A-Za-z]:", p):
        raise ValueError("rooted path")
    out: list[str] = []
    for part in p.split("/"):
        if part == "..":
            if not out:
                raise ValueError("path leaves its root")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def list_directory(paths: DataFrame, directory: str, most: int = 50) -> DataFrame:
    """(kind, name): immediate directories and files, each kind sorted ignoring case and limited."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    under = paths.where(F.lower("path").startswith(prefix.lower())).select(F.substring("path", len(prefix) + 1, 1 << 20).alias("rest"))
    kind = F.when(F.instr("rest", "/") > 0, "dir").otherwise("file")
    found = under.select(kind.alias("kind"), F.substring_index("rest", "/", 1).alias("name")).distinct()
    order = Window.partitionBy("kind").orderBy(F.lower("name"), "name")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def find_files(paths: DataFrame, pattern: str, most: int = 30) -> DataFrame:
    """(path, new_dir): paths that match anywhere, ignoring case, sorted and limited; new_dir where the directory changes."""
    hits = paths.where(F.col("path").rlike(f"(?i){pattern}")).orderBy(F.lower("path"), "path").limit(most)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    order = Window.orderBy(F.lower("path"), "path")  # at most ``most`` rows
    return hits.withColumn("dir", folder).withColumn("new_dir", ~F.lag("dir").over(order).eqNullSafe(F.col("dir")))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(split_lines(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def grep(files: DataFrame, pattern: str, ignore_case: bool = True, invert: bool = False, most_files: int = 20, each: int = 5, width: int = 80) -> DataFrame:
    """(path, matches, line, text): the first lines of each file that match, with the count of all; files in path order."""
    hit = F.col("text").rlike(("(?i)" if ignore_case else "") + pattern)
    found = lines(files).where(~hit if invert else hit)
    of_file = Window.partitionBy("path").orderBy("line")
    shown = found.withColumn("n", F.row_number().over(of_file)).withColumn("matches", F.count(F.lit(1)).over(Window.partitionBy("path")))
    best = found.select("path").distinct().orderBy(F.lower("path"), "path").limit(most_files)
    return shown.where(F.col("n") <= each).join(F.broadcast(best), "path").select("path", "matches", "line", truncated(F.col("text"), width).alias("text"))


def grep_counts(files: DataFrame, pattern: str, ignore_case: bool = True, invert: bool = False) -> DataFrame:
    """(path, n): the number of matching lines of every file that has any."""
    hit = F.col("text").rlike(("(?i)" if ignore_case else "") + pattern)
    return lines(files).where(~hit if invert else hit).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def grep_context(files: DataFrame, pattern: str, before: int = 0, after: int = 0) -> DataFrame:
    """(path, line, text, hit): matching lines and those around them, each once."""
    marked = lines(files).withColumn("hit", F.col("text").rlike(pattern))
    near = Window.partitionBy("path").orderBy("line").rowsBetween(-after, before)
    return marked.withColumn("near", F.max("hit").over(near)).where("near").drop("near")


def read_lines(files: DataFrame, first: int, last: int, most: int = 500, width: int = 500) -> DataFrame:
    """(path, line, text) of lines first to last, both included, at most so many, each cut to the width."""
    return lines(files).where(F.col("line").between(first, min(last, first + most - 1))).withColumn("text", truncated(F.col("text"), width))


def head_tail(text: Column, head: int | None = None, tail: int | None = None) -> Column:
    """First ``head`` lines, and of those the last ``tail``."""
    rows = F.split(text, "\n", -1)
    if head is not None:
        rows = F.slice(rows, 1, head)
    if tail is not None:
        rows = F.slice(rows, F.greatest(F.size(rows) - tail + 1, F.lit(1)), F.lit(max(tail, 1)))
    return F.array_join(rows, "\n")


def merged_ranges(ranges: DataFrame, gap: int = 10) -> DataFrame:
    """(doc, start, end, label) -> (doc, start, end, labels): ranges at most ``gap`` apart become one."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("opens", (reach.isNull() | (F.col("start") > reach + gap)).cast("int"))
    islands = islands.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("label")).alias("labels")).drop("island")


def uncovered(ranges: DataFrame, fetched: DataFrame) -> DataFrame:
    """Ranges (doc, start, end) that no merged fetched range of their document contains."""
    m = merged_ranges(fetched.withColumn("label", F.lit("")), 0).select(F.col("doc").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    return ranges.join(m, (F.col("doc") == F.col("d")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")), "left_anti")


def enclosing_block(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, s, e) -> the deepest node that holds the range; of equals the smallest node_id.  nodes: (doc, node_id, depth, start, end)."""
    inside = points.select("doc", "s", "e").distinct().join(nodes, "doc").where((F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e")))
    return inside.groupBy("doc", "s", "e").agg(F.min_by("node_id", F.struct(-F.col("depth"), F.col("node_id"))).alias("node_id"))


def within_budget(blocks: DataFrame, budget: int = 8192) -> DataFrame:
    """(grp, pos, text): blocks in order until the budget of characters is used; the crossing one is cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("room", F.greatest(F.lit(0), F.lit(budget) - before)).where("room > 0").withColumn("text", F.left(F.col("text"), F.col("room"))).drop("room")


def best_ranges(hits: DataFrame, each: int = 3) -> DataFrame:
    """(doc, start, score): the best of each document, shown by position."""
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "start")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).drop("n").orderBy("doc", "start")


def edit_once(files: DataFrame, find: str, replacement: str) -> DataFrame:
    """(name, matches, content): the only match replaced; with none or several the content stays."""
    n = F.regexp_count(F.col("content"), F.lit(re.escape(find)))
    return files.select("name", n.alias("matches"), F.when(n == 1, F.replace("content", F.lit(find), F.lit(replacement))).otherwise(F.col("content")).alias("content"))


def nth_ancestor(commits: DataFrame, start: str, n: int) -> DataFrame:
    """(sha): the n-th first parent over (sha, parent), by a join for each bit of n."""
    graph = Graph(commits.select("sha", F.array_compact(F.array("parent")).alias("parents")))
    found = ancestors(graph, commits.where(F.col("sha") == start).select("sha", F.lit(n).cast("long").alias("hops")))
    return found.where("ancestor is not null").select(F.col("ancestor").alias("sha"))
