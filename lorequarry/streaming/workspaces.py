"""Workspaces of small text files, replayed from a log of writes, edits and deletes in order.

A log row is (workspace, seq, op, name, content, find, replacement); op is write, edit or delete.  Names compare without case, and a file keeps
the spelling it was made with.  An operation that is refused changes no file, so it does not count for the quotas of later ones; but an
overwrite that is refused for the total gives up the old text's share of the total for good, although the old text stays (``strict``
keeps the share).  Each workspace is folded in the order of seq; a batch run streams a sorted partition and holds one workspace
at a time, whose size the quotas bound, and a stream keeps the files as keyed state.  Both give the same outcomes.

Defined cases: rows with a null workspace, seq or op are refused ("incomplete"), as is an unknown op; a null name or text counts as empty;
rows of one workspace with equal seq are taken in the order of op, name and texts; in a stream, a row whose seq is not after the last one taken is
refused as "late".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LOG = "workspace string, seq long, op string, name string, content string, find string, replacement string"
OUTCOMES = "workspace string, seq long, op string, name string, error string, line int"
REPLAYED = OUTCOMES + ", kind string, content string"
COLUMNS = ["workspace", "seq", "op", "name", "content", "find", "replacement"]
SAFE_NAME = re.compile(r"[A-Za-z0-9._-]+")  # fixed rule of names


@dataclass(frozen=True)
class Quotas:
    """Files of a workspace, and characters of a file and of all files."""

    files: int = 100
    each: int = 1_000_000
    total: int = 5_000_000
    strict: bool = False


@dataclass
class Workspace:
    """Files by lower-case name as (name, text), and the total of their characters that counts."""

    quotas: Quotas
    files: dict[str, tuple[str, str]] = field(default_factory=dict)
    total: int = 0

    def apply(self, op: str, name: str, content: str, find: str, replacement: str) -> tuple[str | None, int | None]:
        """(why it is refused or None, line of an edit)."""
        if op == "write":
            return self.write(name, content), None
        if op == "edit":
            return self.edit(name, find, replacement)
        if op == "delete":
            return self.delete(name), None
        return "unknown operation", None

    def write(self, name: str, content: str) -> str | None:
        if not SAFE_NAME.fullmatch(name):
            return "bad name"
        if len(content) > self.quotas.each:
            return "content too long"
        own = self.files.get(name.lower())
        if own is None and len(self.files) >= self.quotas.files:
            return "too many files"
        rest = self.total - (len(own[1]) if own else 0)
        if rest + len(content) > self.quotas.total:
            if not self.quotas.strict:
                self.total = rest
            return "workspace full"
        self.files[name.lower()] = (own[0] if own else name, content)
        self.total = rest + len(content)
        return None

    def edit(self, name: str, find: str, replacement: str) -> tuple[str | None, int | None]:
        if not find:
            return "nothing to find", None
        own = self.files.get(name.lower())
        if own is None:
            return "no such file", None
        n = own[1].count(find)
        if n != 1:
            if not n:
                return "text not found", None
            lines = dict.fromkeys(own[1].count("\n", 0, m.start()) + 1 for m in re.finditer(re.escape(find), own[1]))
            return f"text found {n} times, in lines " + ", ".join(map(str, lines)), None
        at = own[1].index(find)
        self.files[name.lower()] = (own[0], own[1][:at] + replacement + own[1][at + len(find) :])
        self.total += len(replacement) - len(find)
        return None, own[1].count("\n", 0, at) + 1

    def delete(self, name: str) -> str | None:
        own = self.files.pop(name.lower(), None)
        if own is None:
            return "no such file"
        self.total -= len(own[1])
        return None


def replayed(log: DataFrame, quotas: Quotas = Quotas()) -> DataFrame:
    """A row of kind outcome for each row of the log, and a row of kind file (name, content) for each file left at the end."""
    complete = F.col("workspace").isNotNull() & F.col("seq").isNotNull() & F.col("op").isNotNull()
    odd = log.where(~complete).select("workspace", "seq", "op", "name", F.lit("incomplete").alias("error"), F.lit(None).cast("int").alias("line"), F.lit("outcome").alias("kind"), F.lit(None).cast("string").alias("content"))
    rows = log.where(complete).select(*COLUMNS).repartition("workspace").sortWithinPartitions(*COLUMNS)
    schema = pa.schema([("workspace", pa.string()), ("seq", pa.int64()), ("op", pa.string()), ("name", pa.string()), ("error", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("content", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, space = None, Workspace(quotas)

        def left() -> list[dict]:
            return [{"workspace": name, "seq": None, "op": None, "name": n, "error": None, "line": None, "kind": "file", "content": c} for n, c in space.files.values()]

        for batch in batches:
            out = []
            for own, seq, op, file, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    out += left()
                    name, space = own, Workspace(quotas)
                error, line = space.apply(op, file or "", *(t or "" for t in texts))
                out.append({"workspace": own, "seq": seq, "op": op, "name": file, "error": error, "line": line, "kind": "outcome", "content": None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if space.files:
            yield pa.RecordBatch.from_pylist(left(), schema=schema)

    return rows.mapInArrow(fold, REPLAYED).unionByName(odd)


def outcomes(done: DataFrame) -> DataFrame:
    """(workspace, seq, op, name, error, line) of a replay; error is null where the operation was taken."""
    return done.where("kind = 'outcome'").select("workspace", "seq", "op", "name", "error", "line")


def files(done: DataFrame) -> DataFrame:
    """(workspace, name, content) left at the end of a replay."""
    return done.where("kind = 'file'").select("workspace", "name", "content")


class Replay(StatefulProcessor):
    """The fold over a stream: files, total and last seq of a workspace are its state, and only files that a batch touches are read."""

    def __init__(self, quotas: Quotas):
        self.quotas = quotas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("files", "key string", "name string, content string")
        self.figures = handle.getValueState("figures", "total long, last long, count long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total, last, count = self.figures.get() if self.figures.exists() else (0, None, 0)
        space = Held(self.quotas, self.held, total, count)
        batch = pd.concat(list(rows))  # the rows of one workspace in one micro-batch
        batch = batch.astype(object).where(batch.notna(), None)
        out = []
        order = sorted(batch[COLUMNS].itertuples(index=False), key=lambda r: (int(r.seq), *["" if x is None else "\0" + x for x in r[2:]]))
        started = last
        for r in order:
            seq = int(r.seq)
            if started is not None and seq <= started:
                out.append((r.workspace, seq, r.op, r.name, "late", None))
                continue
            error, line = space.apply(r.op, r.name or "", r.content or "", r.find or "", r.replacement or "")
            last = seq
            out.append((r.workspace, seq, r.op, r.name, error, line))
        space.save()
        self.figures.update((space.total, last, len(space.files)))
        frame = pd.DataFrame(out, columns=["workspace", "seq", "op", "name", "error", "line"])
        frame["line"] = frame["line"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


class _Files(dict):
    """Files read from keyed state when they are asked for; what changes is written back at the end."""

    def __init__(self, state, count: int):
        super().__init__()
        self.state, self.count, self.known = state, count, {}

    def get(self, key, default=None):
        if key not in self.known:
            row = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.known[key] = None if row is None else (row[0], row[1])
        return default if self.known[key] is None else self.known[key]

    def __setitem__(self, key, value):
        self.count += self.get(key) is None
        self.known[key] = value

    def pop(self, key, default=None):
        own = self.get(key)
        if own is not None:
            self.count -= 1
            self.known[key] = None
        return default if own is None else own

    def __len__(self):
        return self.count


class Held(Workspace):
    """A workspace whose files stay in keyed state."""

    def __init__(self, quotas: Quotas, state, total: int, count: int):
        super().__init__(quotas, _Files(state, count), total)

    def save(self) -> None:
        for key, own in self.files.known.items():
            if own is not None:
                self.files.state.updateValue((key,), own)
            elif self.files.state.containsKey((key,)):
                self.files.state.removeKey((key,))


def replayed_stream(log: DataFrame, quotas: Quotas = Quotas()) -> DataFrame:
    """Outcomes of a streamed log; needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = log.where("workspace is not null and seq is not null and op is not null").select(*COLUMNS)
    return rows.groupBy("workspace").transformWithStateInPandas(Replay(quotas), OUTCOMES, "Append", "None")
