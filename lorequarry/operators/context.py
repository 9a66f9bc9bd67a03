"""What an agent asks of a corpus: grep by rank, context around references, blocks not shown yet."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.operators import lexical
from lorequarry.operators.markdown import parse_reference

BLOCKS = ("Paragraph", "ListItem", "CodeBlock", "Blockquote", "Heading")


def groups_by_best(rows: DataFrame, key: str, score: str, most: int) -> DataFrame:
    """(key, best, n, more): the ``most`` groups with the largest score, ties by key; more: how many groups are not shown."""
    groups = rows.groupBy(key).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("n"))
    count = groups.agg(F.count(F.lit(1)).alias("all"))
    best = groups.orderBy(F.desc("best"), key).limit(most)
    return best.crossJoin(F.broadcast(count)).withColumn("more", F.greatest(F.col("all") - most, F.lit(0))).drop("all")  # count: one row


def grep_content(chunks: DataFrame, query: DataFrame, path_filter: str | None = None, most_files: int = 20, each: int = 3, width: int = 60) -> DataFrame:
    """(path, best, start, end, snippet, more_ranges, more_files) of a one-row query table over chunks (chunk_id, path, start, end, raw).

    The ``most_files`` files with the best chunk, and of each its ``each`` best chunks, by place; a snippet is a chunk's
    first characters on one line.  Ties go to the smaller path, then to the earlier place.
    """
    scores = lexical.search(chunks, query, "chunk_id", "raw").select(F.col("id").alias("chunk_id"), F.round("score", 9).alias("score"))
    found = chunks.join(scores, "chunk_id")
    if path_filter is not None:
        found = found.where(F.col("path").rlike(path_filter))
    files = groups_by_best(found, "path", "score", most_files).withColumnsRenamed({"more": "more_files"})
    order = Window.partitionBy("path").orderBy(F.desc("score"), "start")
    text = F.when(F.length("raw") <= width, F.col("raw")).otherwise(F.concat(F.left("raw", F.lit(width - 1)), F.lit("...")))
    snippet = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    shown = found.join(F.broadcast(files), "path").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)  # most_files rows
    return shown.select("path", "best", "start", "end", snippet.alias("snippet"), F.greatest(F.col("n") - each, F.lit(0)).alias("more_ranges"), "more_files")


def block_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, s, e) -> (path, s, e, node_id, start, end): the deepest node that holds the range, or the block nearest above it.

    Of nodes equally deep the first counts; a list that stands in no block stays itself.
    """
    n = nodes.select("path", "node_id", "depth", "type", "start", "end", "ancestors")
    inside = points.select("path", "s", "e").distinct().join(n, "path").where((F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e")))
    own = inside.groupBy("path", "s", "e").agg(F.min_by(F.struct("node_id", "start", "end", "ancestors"), F.struct(-F.col("depth"), F.col("node_id"))).alias("own"))
    up = own.select("path", "s", "e", F.explode(F.concat("own.ancestors", F.array("own.node_id"))).alias("node_id"))
    block = up.join(n.where(F.col("type").isin(*BLOCKS)), ["path", "node_id"]).groupBy("path", "s", "e").agg(F.max_by(F.struct("node_id", "start", "end"), "depth").alias("block"))
    both = own.join(block, ["path", "s", "e"], "left").withColumn("b", F.coalesce("block", F.struct("own.node_id", "own.start", "own.end")))
    return both.select("path", "s", "e", "b.*")


def fetch_context(refs: DataFrame, files: DataFrame, nodes: DataFrame, definitions: DataFrame, budget: int = 8192, around: int = 100, gap: int = 10) -> DataFrame:
    """(request, ref) -> (request, path, start, end, refs, text): what the references of a request point to, as merged ranges.

    Offsets grow to their block (without one by ``around`` characters), definitions to their node; a file is taken whole,
    directories and unknown names give nothing.  Ranges of a file at most ``gap`` apart become one.  Files come by path; the range that crosses the
    request's budget of characters is cut, later ones are left out.
    """
    r = refs.select("request", "ref", parse_reference(F.col("ref")).alias("r")).select("request", "ref", "r.*").where("kind <> 'Directory'")
    sized = files.select("path", "content", F.length("content").alias("size"))
    known = r.join(sized.drop("content"), "path")
    points = known.where("kind = 'Offsets'").select("path", F.col("start").alias("s"), F.col("end").alias("e"))
    blocks = block_nodes(points, nodes).select("path", "s", "e", F.col("start").alias("bs"), F.col("end").alias("be"))
    near = known.where("kind = 'Offsets'").withColumnsRenamed({"start": "s", "end": "e"}).join(blocks, ["path", "s", "e"], "left")
    near = near.select("request", "ref", "path", F.coalesce("bs", F.greatest(F.lit(0), F.col("s") - around)).alias("start"), F.coalesce("be", F.least("size", F.col("e") + around)).alias("end"))
    whole = known.where("kind = 'File'").select("request", "ref", "path", F.lit(0).alias("start"), F.col("size").alias("end"))
    defined = definitions.groupBy("path", F.col("value").alias("definition")).agg(F.min("node_id").alias("node_id"))
    named = known.where("kind = 'Definition'").drop("start", "end").join(defined, ["path", "definition"]).join(nodes.select("path", "node_id", "start", "end"), ["path", "node_id"]).select("request", "ref", "path", "start", "end")
    ranges = near.unionByName(whole).unionByName(named)
    order = Window.partitionBy("request", "path").orderBy("start", "end", "ref")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("opens", (reach.isNull() | (F.col("start") > reach + gap)).cast("int"))
    ranges = ranges.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = ranges.groupBy("request", "path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "end", "ref"))).alias("by"))
    used = F.coalesce(F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("request").orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = merged.withColumn("room", budget - used).where("room > 0").join(sized.drop("size"), "path")
    return room.select("request", "path", "start", "end", F.transform("by", lambda v: v["ref"]).alias("refs"), F.substr("content", F.col("start") + 1, F.least(F.col("room"), F.col("end") - F.col("start")).cast("int")).alias("text"))


def unshown_blocks(markers: DataFrame) -> DataFrame:
    """(conv, pos, path, node_id, start, end, ancestors) -> (conv, pos): the blocks of a conversation that its earlier ones don't show yet.

    A block is skipped if it or a node above it was shown, or if the shown ranges of its file cover it together.  Files of a
    conversation are independent of each other, so each is folded on its own; a task takes its files in turn and holds what is shown of one.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shown = object(), set()
        starts: list[int] = []  # the shown ranges, disjoint and in order
        ends: list[int] = []
        for b in batches:
            convs, at = [], []
            for conv, pos, path, node, start, end, above in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != (conv, path):
                    of, shown, starts, ends = (conv, path), set(), [], []
                i = bisect_right(starts, start) - 1
                if not shown.isdisjoint((node, *above)) or (i >= 0 and end <= ends[i]):
                    continue
                shown.add(node)
                convs.append(conv)
                at.append(pos)
                first, last = bisect_left(ends, start), bisect_right(starts, end)  # ranges that touch the new one
                if first < last:
                    start, end = min(start, starts[first]), max(end, ends[last - 1])
                starts[first:last], ends[first:last] = [start], [end]
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(at, pa.int64())], names=["conv", "pos"])

    rows = markers.select(F.col("conv").cast("long"), F.col("pos").cast("long"), "path", "node_id", "start", "end", "ancestors")
    return rows.repartition("conv", "path").sortWithinPartitions("conv", "path", "pos").mapInArrow(fold, "conv long, pos long")
