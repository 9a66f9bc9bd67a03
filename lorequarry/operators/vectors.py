"""Distances and nearest neighbours of embedding vectors, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.session import cut

KEPT_ROWS = 1 << 19  # results that a task holds at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """1 - a . b, from 0 to 2 for unit vectors; smaller is closer."""
    return F.lit(1.0) - dot(a, b)


def sanitised(v: Column) -> Column:
    """Components below 1e-10 set to 0, then unit length; a zero or non-finite norm leaves the vector as it is."""
    clean = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < 1e-10, 0.0).otherwise(x.cast("double")))
    norm = F.sqrt(dot(clean, clean))
    return F.when((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.transform(clean, lambda x: x / norm)).otherwise(clean)


def knn(vectors: DataFrame, query: list[float], k: int, accept: Column | None = None, without: DataFrame | None = None) -> DataFrame:
    """(vec_id, score, rank) of the k closest vectors, exactly.

    A predicate filters before the top-k, so results never run short; ``without`` (vec_id) leaves out earlier pages.
    """
    rows = vectors if accept is None else vectors.where(accept)
    if without is not None:
        rows = rows.join(without.select("vec_id"), "vec_id", "left_anti")
    q = F.array(*[F.lit(float(x)) for x in query])
    best = rows.select("vec_id", distance(F.col("embedding"), q).alias("score")).orderBy(F.round("score", 9), "vec_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9), "vec_id")))


def _packed(rows: DataFrame, id_col: str, v: str, most: int, name: str) -> DataFrame:
    """Rows of (id, v) in arrays (name) of about ``most`` rows of one width (name_width) and part (name_part), kept in the shared folder."""
    rows = rows.where(F.col(v).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    # dealt by part, never by width alone: that is one key for all rows
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows.count() // most))))
    return cut(rows.groupBy(part.alias(f"{name}_part"), F.size("v").alias(f"{name}_width")).agg(F.collect_list(F.struct("id", "v")).alias(name)))


def _meetings(blocks: DataFrame, batches: DataFrame) -> DataFrame:
    """Every block with every batch of its width, by a cross join that reads the tables again and shuffles neither."""
    return blocks.crossJoin(batches).where("v_width - q_width = 0")  # as an equality, width would be the one key of a shuffle


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 1024, batch_queries: int = 512) -> DataFrame:
    """(query_id, vec_id, score, rank) for each of the queries (query_id, q) against all vectors, exactly.

    Batches of queries meet blocks of vectors, and only the k best of each query leave a task.  Null vectors and
    those of another length than the query have no distance and are left out.
    """
    pairs = _meetings(_packed(vectors, "vec_id", "embedding", block_rows, "v"), _packed(queries, "query_id", "q", batch_queries, "q"))
    return nearest_of_blocks(pairs.select(F.col("q_part").alias("batch"), F.col("v_width").alias("width"), F.col("v").alias("blocks"), F.col("q").alias("batchs")), k)


def _matrix(cell, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of an array of (id, v), by id."""
    ids = cell.values.field("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], cell.values.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)[order]


def nearest_of_blocks(tasks: DataFrame, k: int) -> DataFrame:
    """(batch, width, blocks, batchs) rows, each with an array of vectors and one of queries (id, v) of that width -> (query_id, vec_id, score, rank).

    A task keeps the k best of each query of a batch while its blocks pass, and hands them on, the k best of each query, whenever
    they have become KEPT_ROWS; those of all tasks are ranked at the end.
    """

    def best_of(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = [np.concatenate([np.repeat(q, ids.shape[1]) for q, ids, *_ in kept]), *(np.concatenate([own[i].ravel() for own in kept]) for i in (1, 2, 3))]
        order = np.lexsort((rows[1], rows[3], rows[0]))
        query = rows[0][order]
        first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        return pa.RecordBatch.from_arrays([pa.array(c[order[nth < k]]) for c in rows], names=["query_id", "vec_id", "score", "near"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        held = 0
        for b in batches:
            for i, (batch, width) in enumerate(zip(b.column("batch").to_pylist(), b.column("width").to_pylist(), strict=True)):
                ids, v = _matrix(b.column("blocks")[i], width)
                query_ids, q = _matrix(b.column("batchs")[i], width)
                score = 1.0 - q @ v.T
                near = np.round(score, 9)
                best = np.argsort(near, axis=1, kind="stable")[:, :k]  # ties by the smaller id
                own = [ids[best], np.take_along_axis(score, best, 1), np.take_along_axis(near, best, 1)]
                if (batch, width) in kept:
                    before = kept[batch, width][1:]
                    held -= before[0].size
                    own = [np.concatenate(x, axis=1) for x in zip(before, own, strict=True)]
                    best = np.lexsort((own[0], own[2]), axis=1)[:, :k]
                    own = [np.take_along_axis(x, best, 1) for x in own]
                kept[batch, width] = (query_ids, *own)
                held += own[0].size
                if held >= KEPT_ROWS:
                    yield best_of(list(kept.values()))
                    kept, held = {}, 0
        if kept:
            yield best_of(list(kept.values()))

    found = tasks.select("batch", "width", "blocks", "batchs").mapInArrow(search, "query_id long, vec_id long, score double, near double")
    best = Window.partitionBy("query_id").orderBy("near", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def knn_by_pairs(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 4096, batch_queries: int = 1024) -> DataFrame:
    """The rows of ``knn_batch`` by the distance of every pair: the truth that searches are measured against.

    Every block of vectors meets every batch of queries by a cross join of their tables, of which a task holds one pair at a time; the k best of
    each query in each pair are ranked by Spark.  Vectors with null components have no distance.
    """
    if not k:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")

    def search(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for i, width in enumerate(t.column("v_width").to_pylist()):
                (ids, v), (query_ids, q) = (_matrix(t.column(name)[i], width) for name in "vq")
                score = 1.0 - q @ v.T
                near = np.round(score, 9)
                last = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1, None]
                row, at = np.nonzero((near <= last) | np.isnan(last))  # the k best and what ties with the last
                order = np.lexsort((ids[at], near[row, at], row))
                row, at = row[order], at[order]
                first = np.searchsorted(row, row)
                best = np.arange(len(row)) - first < k
                row, at = row[best], at[best]
                columns = [query_ids[row], ids[at], score[row, at], near[row, at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score", "near"])

    whole = lambda v: F.forall(v, lambda x: x.isNotNull())
    pairs = _meetings(_packed(vectors.where(whole("embedding")), "vec_id", "embedding", block_rows, "v"), _packed(queries.where(whole("q")), "query_id", "q", batch_queries, "q"))
    found = pairs.select("v_width", "v", "q").mapInArrow(search, "query_id long, vec_id long, score double, near double")
    best = Window.partitionBy("query_id").orderBy("near", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def centroid(hits: DataFrame) -> DataFrame:
    """(score, embedding) rows -> one row: the mean weighted by 1 / (score + 0.01), at unit length."""
    w = 1.0 / (F.col("score") + 0.01)
    parts = hits.select(w.alias("w"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.agg(sanitised(ordered).alias("centre"))


def median_and_mad(values: DataFrame, column: str) -> DataFrame:
    """One row: exact median and median absolute deviation of few rows; ``selection.median_and_mad`` takes any number."""
    mid = values.agg(F.percentile(column, 0.5).alias("median"))
    return values.crossJoin(F.broadcast(mid)).groupBy("median").agg(F.percentile(F.abs(F.col(column) - F.col("median")), 0.5).alias("mad"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean share of the true neighbours found; both (query_id, vec_id)."""
    t = truth.select("query_id", F.col("vec_id").alias("v"))
    hit = t.join(found.select("query_id", F.col("vec_id").alias("v"), F.lit(1).alias("hit")), ["query_id", "v"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("r")).agg(F.avg("r").alias("recall"))


def live_vectors(vectors: DataFrame, inserted: DataFrame, removed: DataFrame) -> DataFrame:
    """The next snapshot: new rows replace those of the same vec_id, removed ones go."""
    kept = vectors.join(inserted.select("vec_id"), "vec_id", "left_anti").unionByName(inserted)
    return kept.join(removed.select("vec_id"), "vec_id", "left_anti")
