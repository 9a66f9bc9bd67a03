"""Bursts of events without a fold over a key: pointers to the next possible burst, followed by doubling.

A burst begins at an event and holds what comes until ``millis`` later; the next one begins at the first event at or after that.  Events
lie in buckets of that length, so the one that a burst at an event would hand over to is in one of the next two buckets, or behind a
gap; and an event behind a gap of ``millis`` begins a burst in any case.  From these sure beginnings the pointers are followed, 1, 2, 4, ... at a
time.  All joins are on key and bucket or key and time: a key with most of the events is the work of as many tasks as it has buckets.

Events without key or time are left out; events at the same moment count together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.session import cut


def _events_of(events: DataFrame, width: int) -> DataFrame:
    """(key, b, e): the moments of a key in each bucket, in order, with their numbers of events."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    each = events.where("key is not null and ts is not null").groupBy("key", t.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("key", F.floor(F.col("t") / width).alias("b")).agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("e"))


def _shifted(buckets: DataFrame, by: int, value: Column, name: str) -> DataFrame:
    return buckets.select("key", (F.col("b") + by).alias("b"), value.alias(name))


def followed(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(key, t): the starts, and all that links (key, t, to) lead to from there; in as many rounds as the longest way has bits."""
    seen, jump = cut(starts), cut(links)
    while True:
        new = seen.join(jump, ["key", "t"]).select("key", F.col("to").alias("t")).distinct().join(seen, ["key", "t"], "left_anti")
        new = cut(new)
        if new.isEmpty():  # what is farther away is behind a moment that is known, and that has been followed as far
            return seen
        seen = cut(seen.unionByName(new))
        jump = cut(jump.join(jump.select("key", F.col("t").alias("to"), F.col("to").alias("far")), ["key", "to"]).select("key", "t", F.col("far").alias("to")))


def debounced(events: DataFrame, millis: int = 600) -> DataFrame:
    """(key, ts, n): the first moment of each burst of (key, ts), and its number of events."""
    width = millis * 1000
    buckets = cut(_events_of(events, width))
    e = F.col("e")
    last = F.get(e, F.size(e) - 1)["t"]
    near = buckets.join(_shifted(buckets, 1, last, "before"), ["key", "b"], "left").join(_shifted(buckets, -1, e, "e1"), ["key", "b"], "left").join(_shifted(buckets, -2, F.get(e, F.lit(0))["t"], "t2"), ["key", "b"], "left")

    def pointer(x: Column, i: Column) -> Column:
        follows = F.get(F.filter("e1", lambda y: y["t"] >= x["t"] + width), F.lit(0))["t"]
        sure = (i == 0) & (F.col("before").isNull() | (x["t"] - F.col("before") >= width))
        return F.struct(x["t"].alias("t"), F.coalesce(follows, F.col("t2")).alias("to"), sure.alias("sure"))

    nodes = cut(near.select("key", F.explode(F.transform("e", pointer)).alias("x")).select("key", "x.*"))
    marks = followed(nodes.where("sure").select("key", "t"), nodes.where("to is not null").select("key", "t", "to"))
    held = marks.withColumn("b", F.floor(F.col("t") / width)).join(buckets, ["key", "b"]).join(_shifted(buckets, -1, e, "e1"), ["key", "b"], "left")
    inside = F.filter(F.concat("e", F.coalesce("e1", F.array().cast("array<struct<t:bigint,n:bigint>>"))), lambda y: (y["t"] >= F.col("t")) & (y["t"] < F.col("t") + width))
    return held.select("key", F.timestamp_micros("t").alias("ts"), F.aggregate(inside, F.lit(0).cast("long"), lambda s, y: s + y["n"]).alias("n"))
