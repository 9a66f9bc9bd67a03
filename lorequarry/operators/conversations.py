"""Timelines of messages (conv_id, turn, role, text): compaction, last segment, eligibility, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.text import chat_template, stub


def consumed(timeline: DataFrame) -> DataFrame:
    """With ``consumed``: whether a later assistant message follows."""
    later = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return timeline.withColumn("consumed", F.coalesce(F.max(F.col("role") == "assistant").over(later), F.lit(False)))


def compacted(timeline: DataFrame, role: str = "tool", limit: int = 2000) -> DataFrame:
    """Long results of a role that were consumed already become stubs."""
    hit = (F.col("role") == role) & F.col("consumed")
    return consumed(timeline).withColumn("text", F.when(hit, stub(F.col("text"), limit)).otherwise(F.col("text")))


def last_segment(timeline: DataFrame) -> DataFrame:
    """The messages after the last user turn of each conversation."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return timeline.withColumn("last_user", last).where("turn > last_user")


def parts(timeline: DataFrame, recent: int = 4) -> DataFrame:
    """With ``part``: keep for leading system messages and the most recent user or assistant turns, summary for the rest."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    leading = F.max((F.col("role") != "system").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0
    talk = F.col("role").isin("user", "assistant")
    from_end = F.sum(talk.cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))
    return timeline.withColumn("part", F.when(leading, "keep").when(talk & (from_end <= recent), "keep").otherwise("summary"))


def eligible(timeline: DataFrame) -> DataFrame:
    """Conversations with text of both a user and an assistant."""
    said = F.length(F.trim("text")) > 0
    both = timeline.groupBy("conv_id").agg(F.bool_or((F.col("role") == "user") & said).alias("u"), F.bool_or((F.col("role") == "assistant") & said).alias("a"))
    return both.where("u AND a").select("conv_id")


def rendered(timeline: DataFrame, style: str = "chatml") -> DataFrame:
    """(conv_id, prompt): the messages of a conversation in a chat format."""
    each = F.struct("turn", chat_template(F.col("role"), F.col("text"), style).alias("t"))
    return timeline.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda s: s["t"]), "").alias("prompt"))


def estimated_tokens(timeline: DataFrame) -> DataFrame:
    """(conv_id, tokens): a quarter of the characters of each message, rounded up."""
    return timeline.groupBy("conv_id").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))
