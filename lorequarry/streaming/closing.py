"""Conversations that end: closed by event time, handed on once, and worked off item by item.

``closed_stream`` keeps the turns of each conversation as keyed state.  A timer runs ``gap`` behind its newest turn; when the watermark
passes it, the conversation is emitted as one row, turns in the order of their time.  Turns may come late and out of order as long as the
watermark has not passed them; a later one begins the conversation anew.  An end mark (role ``end``) closes it at its own time.
``closed`` is the batch form over the same columns.

``worked`` calls a step for each item until it says that it is done, at most ``most_turns`` times; an item that fails, goes on too long or is
blank is set aside with the reason and stops no other.  ``work_stream`` does so for each micro-batch and writes results and dead letters into a folder
of the batch's number, so a batch that is repeated after a crash replaces its own rows.

Defined cases: rows with a null conversation or time are left out; a null role or text counts as empty; equal times are ordered by role and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TURNS = "conv string, ts timestamp, role string, text string"
CLOSED = "conv string, started timestamp, ended timestamp, turns long, content string, reason string"
END = "end"
DONE, GO_ON = "done", "go on"


def _content(turns: list[tuple]) -> str:
    return "\n".join(f"{role}: {text}" for _, role, text in turns)


def closed(turns: DataFrame, gap_seconds: int) -> DataFrame:
    """(conv, started, ended, turns, content, reason) of conversations: parted by ``gap_seconds`` or more without a turn, or by an end mark.

    All parts count as closed; reason is timeout or ended.
    """
    rows = turns.where("conv is not null and ts is not null").select(F.col("conv").cast("string").alias("conv"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    along = Window.partitionBy("conv").orderBy("ts", F.col("role") == END, "role", "text")
    before, mark = F.lag("ts").over(along), F.lag("role").over(along)
    opens = before.isNull() | (mark == END) | (F.unix_micros("ts") - F.unix_micros(before) >= gap_seconds * 1_000_000)
    parts = rows.withColumn("__opens", opens.cast("int")).withColumn("__part", F.sum("__opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.when(F.col("role") != END, F.struct("ts", "role", "text"))
    grouped = parts.groupBy("conv", "__part").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sort_array(F.collect_list(said)).alias("said"), F.max(F.col("role") == END).alias("__end"))
    text = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    out = grouped.select("conv", "started", "ended", F.size("said").cast("long").alias("turns"), text.alias("content"), F.when(F.col("__end"), "ended").otherwise("timeout").alias("reason"))
    return out.where("turns > 0")


class Closing(StatefulProcessor):
    """Turns of a conversation until its timer fires."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "ts long, role string, text string")

    def _parts(self, turns: list[tuple]) -> Iterator[list[tuple]]:
        part: list[tuple] = []
        for t in sorted(turns, key=lambda t: (t[0], t[1] == END, t[1], t[2])):
            if part and (part[-1][1] == END or t[0] - part[-1][0] >= self.gap):
                yield part
                part = []
            part.append(t)
        if part:
            yield part

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        for frame in rows:
            held += [(int(ts.value // 1000), role or "", text or "") for ts, role, text in frame[["ts", "role", "text"]].itertuples(index=False)]
        yield from self._emit(key, held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        yield from self._emit(key, held, timerValues)

    def _emit(self, key, held: list[tuple], timer_values) -> Iterator[pd.DataFrame]:
        """Emits the parts that nothing before the watermark can change any more, and keeps the others."""
        mark = timer_values.getCurrentWatermarkInMs() * 1000
        out, kept = [], []
        for part in self._parts(held):
            until = part[-1][0] if part[-1][1] == END else part[-1][0] + self.gap
            if until <= mark:
                said = [t for t in part if t[1] != END]
                if said:
                    stamp = lambda us: pd.Timestamp(us, unit="us")
                    out.append((key[0], stamp(part[0][0]), stamp(part[-1][0]), len(said), _content(said), "ended" if part[-1][1] == END else "timeout"))
            else:
                kept.append((until, part))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.turns.put([t for _, part in kept for t in part])
            self.handle.registerTimer(-(-min(until for until, _ in kept) // 1000))
        else:
            self.turns.clear()
        if out:
            yield pd.DataFrame(out, columns=["conv", "started", "ended", "turns", "content", "reason"])

    def close(self) -> None:
        pass


def closed_stream(turns: DataFrame, gap_seconds: int, late: str = "1 minute") -> DataFrame:
    """Closed conversations of a stream (conv, ts, role, text); needs the RocksDB state store."""
    rows = turns.where("conv is not null and ts is not null").select(F.col("conv").cast("string").alias("conv"), F.col("ts").cast("timestamp").alias("ts"), "role", "text").withWatermark("ts", late)
    return rows.groupBy("conv").transformWithStateInPandas(Closing(gap_seconds), CLOSED, "Append", "EventTime")


def worked(items: DataFrame, text_col: str, factory: Callable[[], Callable[[str, int], str]], most_turns: int = 50) -> DataFrame:
    """items with ``steps`` taken and ``error`` (null where the work got done).

    The factory makes a step in each task: step(text, turn from 0) says done, go on, or why the item failed; it may raise.
    """
    kept = [c for c in items.columns if c not in ("steps", "error")]
    kinds = dict(items.dtypes)
    at = kept.index(text_col)

    def one(step, text: str | None) -> tuple[int, str | None]:
        if text is None or not text.strip():
            return 0, "blank"
        for turn in range(most_turns):
            try:
                said = step(text, turn)
            except Exception as e:  # noqa: BLE001 - whatever a step raises concerns its own item only
                return turn + 1, f"{type(e).__name__}: {e}"[:500]
            if said == DONE:
                return turn + 1, None
            if said != GO_ON:
                return turn + 1, said[:500]
        return most_turns, f"not done after {most_turns} turns"

    def run(batches):
        step = factory()
        for b in batches:
            got = [one(step, t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())], names=[*kept, "steps", "error"])

    return items.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", steps int, error string")


def work_stream(items: DataFrame, text_col: str, factory, good: str, dead: str, checkpoint: str, most_turns: int = 50, **start):
    """Works off what a stream emits; each micro-batch owns the folders ``batch=<number>`` of results and of dead letters."""

    def write(batch: DataFrame, number: int) -> None:
        at = f"{good}/.work-{number}"
        worked(batch, text_col, factory, most_turns).write.mode("overwrite").parquet(at)  # an item is worked off once a batch
        done = batch.sparkSession.read.parquet(at)
        done.where("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/batch={number}")
        done.where("error is not null").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(start or {"availableNow": True})).start()
