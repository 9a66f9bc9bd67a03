"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers and dealt into blocks of rows.  The index holds, for each block and component, one
bitmap for each bit of the component (less the block's smallest value), a bit for each row.  For a query the slices are
added with bitmap arithmetic only: each set bit of a query component adds its slices at the fitting weight (of the
complement where the component is negative), and carry-save adders reduce every weight to one slice.  The top rows are
selected from the most significant slice of the sums downward; rows that tie at the boundary are taken by smaller id.
The k best of every block then meet in one ranking for each query.

Each (query batch, block) pair is a task of its own; a task holds one block's slices and one batch of queries.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as query nor as
candidate; empty vectors score 0 among themselves; a query's candidates are the vectors of its own length; fewer than k candidates give fewer rows; ties go to the
smaller id, and rows that share an id are candidates each; queries never meet rows of their own id; inner products that
may not fit a long raise an error; an empty table gives no rows; other columns are not read.  vec_id must be a number or
its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.durable import durable

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component) of the vectors that take part."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def bit_slices(values: np.ndarray) -> np.ndarray:
    """Rows x components of non-negative integers -> components x bits x words."""
    rows, dims = values.shape
    bits = max(1, int(values.max(initial=0)).bit_length())
    padded = np.zeros((-(-rows // 64) * 64, dims), np.uint64)
    padded[:rows] = values
    out = np.empty((dims, bits, len(padded) // 64), np.uint64)
    for b in range(bits):
        bit = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[:, b] = np.packbits(bit.T.copy(), axis=1, bitorder="little").view("<u8")
    return out


def add_slices(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by weight, each an array terms x words -> one bitmap for each weight of the sum, by carry-save adders."""
    out = []
    w = 0
    while w <= max(columns):
        terms = columns.get(w, [])
        stack = np.concatenate(terms) if terms else None
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                ab = a ^ b
                total, carry = ab ^ c, (a & b) | (c & ab)
                stack = np.concatenate([total, stack[3 * n :]])
            else:
                total, carry = stack[:1] ^ stack[1:2], stack[:1] & stack[1:2]
                stack = total
            columns.setdefault(w + 1, []).append(carry)
        out.append(stack[0] if stack is not None else None)
        w += 1
    zero = np.zeros_like(next(s for s in out if s is not None))
    return [zero if s is None else s for s in out]


def top_rows(sums: list[np.ndarray], exists: np.ndarray, k: int) -> np.ndarray:
    """Rows with the k largest sums, found from the most significant slice downward; ties by smaller row."""
    sure = np.zeros_like(exists)
    open_ = exists.copy()
    for s in reversed(sums):
        tried = sure | (open_ & s)
        n = int(np.bitwise_count(tried).sum())
        if n > k:
            open_ &= s
        else:
            sure = tried
            open_ &= ~s
            if n == k:
                open_[:] = 0
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    edge = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: k - len(rows)]
    return np.concatenate([rows, edge])


def search_block(slices: np.ndarray, low: int, ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, row id, score) of the k best rows of a block for each query."""
    dims, bits, words = slices.shape
    exists_all = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view("<u8")
    flipped = slices ^ ONES
    found = []
    for qid, q in zip(query_ids.tolist(), queries, strict=True):
        own = np.flatnonzero(ids == qid)
        exists = exists_all.copy()
        for r in own:
            exists[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        size = np.abs(q)
        sides = np.where((q < 0)[:, None, None], flipped, slices)
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(max(1, int(size.max(initial=0)).bit_length())):
            use = np.flatnonzero((size >> j) & 1)
            if len(use):
                part = sides[use]
                for b in range(bits):
                    columns.setdefault(j + b, []).append(part[:, b])
        rows = top_rows(add_slices(columns), exists, k) if columns else np.flatnonzero(np.unpackbits(exists.view(np.uint8), bitorder="little"))[:k]
        scores = values[rows] @ q
        found.append((np.full(len(rows), qid), ids[rows], scores))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def build_index(rows: DataFrame, block_rows: int = 1024) -> DataFrame:
    """(dims, block, low, bits, slices, ids, kind, raw): the bit-sliced index; a block gets block_rows vectors or so of one length, by a hash of the id."""
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("vec_id")
        dims, block = key[0].as_py(), key[1].as_py()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dims)
        low = int(flat.min()) if dims else 0
        slices = bit_slices((flat - low).astype(np.uint64))
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.array_equal(flat.astype(t), flat))
        yield pa.RecordBatch.from_pylist(
            [{"dims": dims, "block": block, "low": low, "bits": slices.shape[1], "slices": slices.tobytes(), "ids": ids.tobytes(), "kind": kind, "raw": flat.astype(kind).tobytes()}],
            schema=pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("low", pa.int64()), ("bits", pa.int32()), ("slices", pa.binary()), ("ids", pa.binary()), ("kind", pa.string()), ("raw", pa.binary())]),
        )

    dealt = rows.withColumn("dims", F.size("v")).join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    return dealt.select("dims", "block", "vec_id", "v").groupBy("dims", "block").applyInArrow(build, "dims int, block long, low long, bits int, slices binary, ids binary, kind string, raw binary")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, block_rows: int = 1024, batch_queries: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest inner products for each query; both (vec_id, v)."""
    index = durable(build_index(rows, block_rows), "slices")
    # queries of one length are dealt into batches, and each batch goes to every block of that length: the stated query set against all rows
    per_length = queries.groupBy(F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / batch_queries).cast("long").alias("batches"))
    packed = queries.withColumn("dims", F.size("v")).join(per_length, "dims")
    packed = packed.groupBy("dims", F.pmod(F.xxhash64("vec_id"), F.col("batches")).alias("batch")).agg(F.collect_list("vec_id").alias("qids"), F.collect_list("v").alias("qs"))
    pairs = index.select("dims", "block").join(per_length, "dims").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
    tasks = pairs.join(packed, ["dims", "batch"]).join(index, ["dims", "block"]).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dims", "block", "batch")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                ids, dims = np.frombuffer(t["ids"], "<i8"), t["dims"]
                slices = np.frombuffer(t["slices"], "<u8").reshape(dims, t["bits"], -(-len(ids) // 64))
                values = np.frombuffer(t["raw"], t["kind"]).reshape(len(ids), dims).astype(np.int64)
                asked = np.array(t["qs"], np.int64).reshape(-1, dims) if dims else np.zeros((len(t["qids"]), 0), np.int64)
                if dims * int(np.abs(values).max(initial=0)) * int(np.abs(asked).max(initial=0)) >= 2**63:
                    raise OverflowError("inner products of these vectors do not fit a long")
                got = search_block(slices, t["low"], ids, values, np.array(t["qids"]), asked, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["query_id", "vec_id", "score"])

    found = tasks.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
