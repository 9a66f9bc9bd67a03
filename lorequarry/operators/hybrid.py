"""Hybrid retrieval: vector and term hits, coherence filter, reciprocal-rank fusion, gap terms, bounding trees.

All stages are DataFrames over one lazy plan; the tables after the two top-k steps hold at most some hundred rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.text import poisson_cdf, terms
from lorequarry.operators import lexical, vectors


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, rank) lists -> (id, score): the sum of 1 / (k + rank)."""
    rows = reduce(DataFrame.unionByName, [x.select("id", "rank") for x in lists])
    return rows.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def coherent(hits: DataFrame, bootstrap: int = 15, multiplier: float = 5.0) -> DataFrame:
    """(id, rank, score, embedding) -> hits no farther from the centroid than median + multiplier * MAD.

    Centroid and spread come from the best ``bootstrap`` hits; ranks are given anew.
    """
    first = hits.where(F.col("rank") <= bootstrap)
    centre = F.broadcast(vectors.centroid(first.select("score", "embedding")))  # one row
    placed = hits.crossJoin(centre).withColumn("off", vectors.distance(F.col("embedding"), F.col("centre"))).drop("centre")
    bounds = vectors.median_and_mad(placed.where(F.col("rank") <= bootstrap), "off")
    kept = placed.crossJoin(F.broadcast(bounds)).where(F.col("off") <= F.col("median") + multiplier * F.col("mad"))
    again = Window.orderBy("rank")  # the hits of one query
    return kept.withColumn("rank", F.row_number().over(again)).select("id", "rank", "score", "off")


def fast_context(chunks: DataFrame, embedded: DataFrame, query: DataFrame, vector: list[float], near: int = 100, lexical_hits: int = 30, bootstrap: int = 15, multiplier: float = 5.0) -> DataFrame:
    """(id, score) by fused rank: chunks (doc_id, text), embedded (vec_id, embedding), a one-row query table.

    Without vector hits the result is empty, even where terms match.
    """
    v = vectors.knn(embedded, vector, near).join(embedded.select("vec_id", "embedding"), "vec_id").withColumnRenamed("vec_id", "id")
    accepted = coherent(v, bootstrap, multiplier)
    words = lexical.top(lexical.search(chunks, query), lexical_hits)
    some = v.limit(1).select(F.lit(1).alias("__any"))
    return reciprocal_rank_fusion([accepted, words.crossJoin(F.broadcast(some))])


def memory_search(memories: DataFrame, embedded: DataFrame, query: DataFrame, vector: list[float], keep: int = 5, each: int = 20, gate: Column | None = None, by_id: bool = False) -> DataFrame:
    """kNN and BM25 (each 20) -> fusion -> best 20 -> gate -> keep, in fused order (``by_id``: in the order of ids)."""
    v = vectors.knn(embedded, vector, each).withColumnRenamed("vec_id", "id")
    words = lexical.top(lexical.search(memories, query), each)
    fused = reciprocal_rank_fusion([v, words]).orderBy(F.desc(F.round("score", 12)), "id").limit(20)
    passed = fused if gate is None else fused.join(memories, F.col("id") == F.col("doc_id")).where(gate).select("id", "score")
    order = ["id"] if by_id else [F.desc(F.round("score", 12)), F.col("id")]
    return passed.orderBy(*order).limit(keep)


def yes_gate(logprob: Column, threshold: float) -> Column:
    """exp(logprob of YES) >= threshold; a missing YES has probability 0."""
    return F.coalesce(F.exp(logprob), F.lit(0.0)) >= threshold


def gap_terms(results: DataFrame, query: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(term, n, p): query terms that stand in significantly few result texts, by a Poisson test against the mean."""
    asked = query.select(F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    held = results.select("id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counts = asked.join(held, "term", "left").groupBy("term").agg(F.count("id").alias("n"))
    rate = counts.agg(F.avg("n").alias("rate"))
    return counts.crossJoin(F.broadcast(rate)).withColumn("p", poisson_cdf(F.col("n"), F.col("rate"))).where(F.col("p") < alpha).select("term", "n", "p")


def bounding_trees(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, score) hits -> (root, hits, total, mean, chars): each hit goes to its highest ancestor that is a parent of a hit.

    nodes: (node_id, parent_id, depth, start, end, ancestors); the document node (depth 0) is never a parent.
    """
    own = hits.join(nodes, "node_id")
    parents = own.join(nodes.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("d")), "parent_id").where("d > 0").select(F.col("parent_id").alias("logical")).distinct()
    up = own.select("node_id", "score", F.explode(F.concat("ancestors", F.array("node_id"))).alias("logical")).join(parents, "logical")
    depth = nodes.select(F.col("node_id").alias("logical"), F.col("depth").alias("d"))
    highest = up.join(depth, "logical").groupBy("node_id", "score").agg(F.min_by("logical", "d").alias("root"))
    rooted = own.select("node_id", "score").join(highest, ["node_id", "score"], "left").select("score", F.coalesce("root", "node_id").alias("root"))
    trees = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("total"), F.avg("score").alias("mean"))
    return trees.join(nodes.select(F.col("node_id").alias("root"), (F.col("end") - F.col("start")).alias("chars")), "root")


def ordered_output(trees: DataFrame, most_files: int = 3, most_trees: int = 10) -> DataFrame:
    """(path, root, start, end, mean, heading) trees -> (path, score, start, end, section, too_much), in the order of the report.

    A document's score is the mean of its trees' means; documents come best first (ties by path), their trees by place.
    too_much: whether the report says that it holds more than ``most_files`` documents or ``most_trees`` trees.
    """
    scored = trees.groupBy("path").agg(F.avg("mean").alias("score"), F.count(F.lit(1)).alias("n"))
    size = scored.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("all"))
    flag = F.broadcast(size.select(((F.col("files") > most_files) | (F.col("all") > most_trees)).alias("too_much")))  # one row
    out = trees.join(scored.drop("n"), "path").crossJoin(flag).orderBy(F.desc(F.round("score", 12)), "path", "start")
    return out.select("path", "score", "start", "end", F.concat(F.lit("@"), "heading").alias("section"), "too_much")


def rerank(documents: DataFrame, relevance: Column, n: int) -> DataFrame:
    """The n most relevant documents by a pluggable score column; ties by id."""
    return documents.withColumn("relevance", relevance).orderBy(F.desc("relevance"), "id").limit(n)
