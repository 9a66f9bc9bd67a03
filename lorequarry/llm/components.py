"""Connected components of a link table, by alternating stars.

Each round sends every node's larger neighbours to its smallest one, then each node and its smaller neighbours to the
smallest of them; the links end as stars around the smallest node of every component.  A round is two grouped minima
(summed up before the shuffle) and two joins on the node (which Spark may split where a node has very many links).
Rounds are written to the shared folder, where a round's table is deleted once the next one stands; they stop when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.durable import discard, durable


def _stars(links: DataFrame) -> DataFrame:
    """One round over (a, b) with a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of any order -> (node, component): every linked node with the smallest node that it can reach.

    Null ends and links to itself are left out; nodes without links have no row.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at = durable(ends, "links")
    seen = None
    while True:
        state = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state["n"] or state == seen:
            break
        seen = state
        before, at = at, durable(_stars(at), "links")
        discard(before)
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
