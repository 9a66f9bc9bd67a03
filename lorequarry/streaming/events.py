"""Event streams: sessions, throttling, debouncing, dispatch, and ingestion with dead letters.

Each transformation has a batch form over the same columns (key, ts, ...); streams use the same code where Spark allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "72 hours", late: str | None = None) -> DataFrame:
    """(key, start, end, n): activity sessions that end after ``gap`` without an event; ``late`` sets a watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    s = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expired(sessions_: DataFrame, now: str) -> DataFrame:
    """Sessions whose end is not after ``now``."""
    return sessions_.where(F.col("end") <= F.lit(now).cast("timestamp"))


def throttled(events: DataFrame, chars: int = 120, seconds: float = 2.0) -> DataFrame:
    """(key, ts, total): emitted states of growing texts (key, ts, len), when enough is new or enough time went by, and at the end."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "len"])
        out, sent_at, sent, total = [], None, 0, 0
        for ts, n in zip(rows["ts"], rows["len"], strict=True):
            total += int(n)
            if sent_at is None or total - sent >= chars or (ts - sent_at).total_seconds() >= seconds:
                out.append((rows["key"].iloc[0], ts, total))
                sent_at, sent = ts, total
        if total > sent:
            out.append((rows["key"].iloc[0], rows["ts"].iloc[-1], total))
        return pd.DataFrame(out, columns=["key", "ts", "total"])

    return events.select("key", "ts", "len").groupBy("key").applyInPandas(fold, "key long, ts timestamp, total long")


def throttled_stream(events: DataFrame, chars: int = 120, seconds: float = 2.0) -> DataFrame:
    """The same over a stream, with (sent_at, sent, total) as the state of a key; what is pending is emitted on timeout."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent_at, sent, total = state.get if state.exists else (None, 0, 0)
        out = []
        if state.hasTimedOut:
            if total > sent:
                out.append((key[0], pd.Timestamp(sent_at, unit="us"), total))
            state.remove()
        else:
            for rows in batches:
                for ts, n in rows.sort_values(["ts", "len"])[["ts", "len"]].itertuples(index=False):
                    total += int(n)
                    now = ts.value // 1000
                    if sent_at is None or total - sent >= chars or now - sent_at >= seconds * 1e6:
                        out.append((key[0], ts, total))
                        sent_at, sent = now, total
            state.update((sent_at, sent, total))
            state.setTimeoutDuration(60_000)
        yield pd.DataFrame(out, columns=["key", "ts", "total"])

    return events.select("key", "ts", "len").groupBy("key").applyInPandasWithState(step, "key long, ts timestamp, total long", "sent_at long, sent long, total long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounced(events: DataFrame, millis: int = 600) -> DataFrame:
    """(key, ts, n): bursts; the first event starts a timer that later ones don't reset, and events until it fires belong to it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for ts in rows["ts"].sort_values():
            if out and ts - out[-1][1] < pd.Timedelta(milliseconds=millis):
                out[-1][2] += 1
            else:
                out.append([rows["key"].iloc[0], ts, 1])
        return pd.DataFrame(out, columns=["key", "ts", "n"])

    return events.select("key", "ts").groupBy("key").applyInPandas(fold, "key long, ts timestamp, n long")


def run_timeouts(runs: DataFrame, minutes: int = 14) -> DataFrame:
    """(channel, started, ended) with ``timed_out``, and ``refused`` where an earlier run of the channel was still active."""
    w = Window.partitionBy("channel").orderBy("started").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("started") + F.make_dt_interval(mins=F.lit(minutes))
    until = F.least(F.col("ended"), limit)
    return runs.withColumn("timed_out", F.col("ended") > limit).withColumn("refused", F.coalesce(F.max(until).over(w) > F.col("started"), F.lit(False)))


def dispatched(events: DataFrame, handlers: DataFrame) -> DataFrame:
    """(event_id, handler, ran): handlers in order of priority; after a critical one that fails none runs.

    events (event_id, event_type); handlers (handler, event_type, priority, critical, fails).
    """
    calls = events.join(handlers, "event_type")
    order = Window.partitionBy("event_id").orderBy(F.desc("priority"), "handler").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("critical") & F.col("fails")).over(order), F.lit(False))
    return calls.withColumn("ran", ~stopped).select("event_id", "handler", "priority", "ran")


def ingest(stream: DataFrame, valid, good_path: str, dead_path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Runs what is available of a stream: valid rows are transformed and appended, the others go to a dead-letter table."""

    def write(batch: DataFrame, _: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        transform(batch.where(ok)).write.mode("append").parquet(good_path)
        batch.where(~ok).write.mode("append").parquet(dead_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
