"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The shuffled token stream of every source is read at most ``repeat_cap`` times in a row and cut into blocks of
equally many tokens.  Slot i of the schedule has the point frac(i * golden ratio), which is mapped through the
cumulative target weights to a source; the slots of a source are ranked, and the slot of rank r takes block r.
Three times as many points as slots are drawn: no gap between so many golden-ratio points exceeds 1 / slots, so each
source gets all the slots it needs, and the surplus ranks are left out.  The ratio is that of two large Fibonacci
numbers and the points are whole multiples of their fraction, so the sequence is exact at any length.

Nothing orders a whole source in one task: documents are put in hash order in two steps (bucket by hash, then inside
the bucket), and so are the slots (chunk of the sequence, then inside the chunk).  Points meet the ranges of the
sources by bins of equal width.  Only the sources table (a row for each source) is ordered in one window.

Defined cases: a null text has no words; a null source is a source of its own and comes last; documents without words
take 0; an empty table gives no rows; repeated rows are separate documents; other columns are left alone and no
column of the input other than the three named ones is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.durable import durable, small_side

WORDS = r"[^\x20\x09-\x0D]+"
FIBONACCI = (259695496911122585, 420196140727489673)  # the 85th and the 86th: their ratio is as irregular as whole numbers allow


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeat_cap: int = 2) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Targets share ``share`` times all sizes by weight; none exceeds ``repeat_cap`` times its source's size, and the
    excess is shared again by weight among the others until none is above.  The fixed point is target =
    min(cap, level * weight) for one level, found by going through the sources in the order of cap / weight.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(repeat_cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open_weight"))
    )
    # the first source whose cap is not below the level fixes the level; if all caps are below, every target is its cap
    fixed = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    s = s.withColumn("level", fixed.over(everything)["level"])
    return s.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeat_cap: int = 2, block_tokens: int = 4096, seed: int = 7, docs_per_bucket: int = 500) -> DataFrame:
    """documents -> (doc_id, size, source_size, target, taken, source, tie), a row for each document; tie is a hash of the text."""
    at = [F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("at"), F.xxhash64("text").alias("tie")]
    rows = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *at), "sizes")  # texts are read once
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / docs_per_bucket)).cast("long")
    targets = source_targets(per_source.select("source", "source_size"), weights, share, repeat_cap)
    one = Window.partitionBy()
    up_to = Window.orderBy(F.col("source").asc_nulls_last())
    plan = durable(
        targets.join(per_source.select(F.col("source").alias("s2"), buckets.alias("buckets")), F.col("source").eqNullSafe(F.col("s2")))
        .withColumn("key", F.row_number().over(up_to))
        .withColumn("takes", F.floor("target").cast("long"))
        .withColumn("block", F.lit(block_tokens).cast("long"))
        .withColumn("slots", F.ceil(F.col("takes") / F.col("block")).cast("long"))
        .withColumn("all_slots", F.sum("slots").over(one))
        .withColumn("to", F.sum("slots").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
        .select("source", "source_size", "target", "key", "buckets", "takes", "block", "slots", "all_slots", (F.col("to") - F.col("slots")).alias("from"), "to"),
        "plan",
    )

    # documents in hash order: offset of the bucket in its source, then of the document in its bucket
    placed = rows.join(plan.select(F.col("source").alias("s2"), "key", "buckets", "block", "takes", "source_size", "target"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    placed = placed.withColumn("bucket", F.floor((F.shiftrightunsigned("at", 33) / F.lit(2.0**31)) * F.col("buckets")).cast("long"))
    in_order = Window.partitionBy("key", "bucket").orderBy("at", "doc_id", "size", "tie")
    placed = placed.withColumn("nth", F.row_number().over(in_order)).withColumn("p", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    offsets = rows.join(plan.select(F.col("source").alias("s2"), "key", "buckets"), F.col("source").eqNullSafe(F.col("s2")))
    offsets = offsets.groupBy("key", F.floor((F.shiftrightunsigned("at", 33) / F.lit(2.0**31)) * F.col("buckets")).cast("long").alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    offsets = offsets.withColumn("offset", F.sum("in_bucket").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")).drop("in_bucket")
    placed = placed.join(offsets, ["key", "bucket"]).withColumn("p", F.col("p") + F.col("offset"))

    # every reading of a document, cut at the block borders
    pieces = placed.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeat_cap - 1)), lambda e: F.col("p") + e * F.col("source_size"))))
    blocks = F.when((F.col("size") > 0) & (F.col("start") < F.col("takes")), F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))))
    pieces = pieces.withColumn("rank", F.explode_outer(blocks))
    slots = schedule(plan)
    end = F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * F.col("block"), F.col("takes"))
    overlap = F.when(F.col("slot").isNotNull(), F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.col("rank") * F.col("block")))).otherwise(0)
    joined = pieces.join(slots, ["key", "rank"], "left")
    mixed = joined.groupBy("key", "bucket", "nth", "doc_id", "size", "source_size", "target", "source", "tie").agg(F.sum(overlap).cast("long").alias("taken"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken", "source", "tie")


def schedule(plan: DataFrame, chunk: int = 4096) -> DataFrame:
    """(key, slots, all_slots, from, to) of each source -> (key, rank, slot): which slot of the schedule takes block ``rank`` of source ``key``."""
    spark = plan.sparkSession
    digits = plan.select(F.col("all_slots").cast("long")).limit(1)
    step, modulus = (F.lit(x).cast("decimal(18,0)") for x in FIBONACCI)
    wide = lambda c: c.cast("decimal(20,0)")
    # source k has the points from edge(from) up to edge(to)
    edge = lambda c: F.call_function("div", wide(F.col(c)) * modulus + wide(F.col("all_slots") - 1), wide(F.col("all_slots")))
    ranges = plan.where("slots > 0").select("key", "slots", edge("from").alias("lo"), edge("to").alias("hi"))
    bins = max(64, 4 * plan.count())
    width = -(-FIBONACCI[1] // bins)
    in_bin = lambda c: F.call_function("div", c, F.lit(width))
    ranges = ranges.withColumn("bin", F.explode(F.sequence(in_bin(F.col("lo")), in_bin(F.col("hi") - 1))))
    # 3 * all_slots points, made where they are used: a row for each chunk, then its points
    chunks = digits.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(3 * F.col("all_slots") / chunk).cast("long"))).alias("chunk"), "all_slots")
    chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    points = chunks.select("chunk", "all_slots", F.explode(F.sequence(F.col("chunk") * chunk, (F.col("chunk") + 1) * chunk - 1)).alias("slot"))
    points = points.where(F.col("slot") < 3 * F.col("all_slots")).withColumn("u", F.pmod(wide(F.col("slot") + 1) * step, modulus).cast("long"))
    points = points.withColumn("bin", in_bin(F.col("u")))
    drawn = points.join(ranges, "bin").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("key", "chunk", "slot", "slots")
    totals = drawn.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("in_chunk"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("offset", F.sum("in_chunk").over(before) - F.col("in_chunk")).drop("in_chunk")
    ranked = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot"))).join(totals, ["key", "chunk"])
    return ranked.withColumn("rank", F.col("offset") + F.col("nth") - 1).where("rank < slots").select("key", "rank", "slot")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself as documents: each one as often as its taken words make up its size, rounded to whole copies.

    Documents without words are left out; of rows that agree in doc_id, source and text each comes as often as the one
    that is taken most.  A null doc_id is one like others.
    """
    names = docs.columns
    key = F.struct("doc_id", "source", F.xxhash64("text"))
    taken = mix_sources(docs, **how).where("size > 0").groupBy("doc_id", "source", "tie")
    copies = taken.agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("__copies")).where("__copies > 0")
    copies = small_side(durable(copies.select(F.struct("doc_id", "source", "tie").alias("__key"), "__copies"), "copies"))
    return docs.join(copies, key.eqNullSafe(F.col("__key"))).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in names])
