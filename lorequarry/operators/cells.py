"""Persisted vector cells: an inverted file of vectors, probed by partition pruning and ranked exactly.

Spherical k-means on a bounded sample (``fit_rows`` vectors, drawn by a hash of their ids) gives the centres; every vector is then written
to the partition of its closest centre, a large cell in several files.  A search scans the cells whose centres are closest to the query and
ranks what is there by exact distance, so results can miss neighbours in other cells but never hold a wrong distance or order.
How many cells that takes depends on the data: the share of the ten nearest neighbours that lie in the closest 1, 2, 3, ... cells is measured
on the sample and stored with the index, and ``probes_for`` reads off the count for a wanted recall (a little more than is needed, as neighbours are
closer among all vectors than in a sample).  With all cells it is the exact search, which stays the default of the library (``vectors.knn``).

Changes add immutable parts, named by versioned manifests: added vectors go to cells of the same centres, removed ids become
tombstones that hide vectors of earlier parts.  ``build`` anew once the index has grown a lot.

Defined cases: vectors that are null, zero, of another length than the centres, or hold null or non-finite components, are left out
(the exact search has no distance for most of them either); an id that is added again replaces nothing unless it is removed in the same
change or before; an empty table makes an index without cells, which finds nothing.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.operators import vectors as V
from lorequarry.sources import versions

VECTORS = "vec_id long, embedding array<double>"
RECALL = 0.97  # what a search aims at, unless the number of probes is given
FILE_ROWS = 50_000  # vectors a file of a cell holds, or so
BLOCK_SCORES = 1 << 19  # cosines with centres that are looked at together
PLACED_ROWS = 1 << 14  # rows that leave a task together
SENT_ROWS = 2_000_000  # tombstones of 8 bytes are sent to all tasks up to here, and shuffled beyond


@dataclass(frozen=True)
class CellIndex:
    """One version: centres (cells x dimension, bounded by ``most_cells``), parts with their rows by cell, and tombstones."""

    spark: SparkSession
    folder: str
    version: int
    centres: np.ndarray
    parts: tuple[dict, ...]  # name, place, cells: {cell: rows}, removed: rows
    curve: tuple[float, ...]  # measured recall by number of probes, from 1

    def probes_for(self, recall: float) -> int:
        """The smallest number of probes that reached this recall on the sample; all cells where none did."""
        return next((i + 1 for i, r in enumerate(self.curve) if r >= recall), max(1, len(self.centres)))

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(vec_id, embedding, cell) of the vectors in some cells (all, where none are named)."""
        wanted = set(range(len(self.centres))) if cells is None else set(cells)
        out = self.spark.createDataFrame([], VECTORS + ", cell int, place int")
        for p in self.parts:
            if wanted & {int(c) for c in p["cells"]}:
                read = self.spark.read.schema(VECTORS + ", cell int").parquet(f"{self.folder}/parts/{p['name']}/vectors")
                out = out.unionByName((read if cells is None else read.where(F.col("cell").isin(sorted(wanted)))).withColumn("place", F.lit(p["place"])))
        removed = [p for p in self.parts if p["removed"]]
        if removed:
            gone = self.spark.createDataFrame([], "vec_id long, place int")
            for p in removed:
                gone = gone.unionByName(self.spark.read.schema("vec_id long").parquet(f"{self.folder}/parts/{p['name']}/removed").withColumn("place", F.lit(p["place"])))
            gone = gone.groupBy(F.col("vec_id").alias("__id")).agg(F.max("place").alias("__place"))
            gone = F.broadcast(gone) if sum(p["removed"] for p in removed) <= SENT_ROWS else gone
            out = out.join(gone, (F.col("vec_id") == F.col("__id")) & (F.col("__place") > F.col("place")), "left_anti")
        return out.drop("place")

    def sizes(self) -> dict[int, int]:
        """Vectors written to each cell, removed ones included."""
        out: dict[int, int] = {}
        for p in self.parts:
            for c, n in p["cells"].items():
                out[int(c)] = out.get(int(c), 0) + n
        return out


def _usable(vectors: DataFrame, dims: int) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) == dims) & finite & F.exists(x, lambda c: c != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))


def fit_centres(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means; a cell that runs empty starts again at the vector farthest from its centre."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        home, best = nearest_centres(x, centres, 1)
        home = home[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(norm < 1e-12)
        sums[lost] = x[np.argsort(best[:, 0])[: len(lost)]]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, cosines) of the ``many`` closest centres of each row, closest first, in blocks of BLOCK_SCORES cosines."""
    many = min(many, len(centres))
    cells, scores = np.empty((len(x), many), np.int32), np.empty((len(x), many))
    rows = max(1, BLOCK_SCORES // max(1, len(centres)))
    for a in range(0, len(x), rows):
        s = x[a : a + rows] @ centres.T
        order = s.argmax(1)[:, None] if many == 1 else np.argsort(-s, axis=1, kind="stable")[:, :many]
        cells[a : a + rows], scores[a : a + rows] = order, np.take_along_axis(s, order, 1)
    return cells, scores


def recall_curve(x: np.ndarray, centres: np.ndarray, asked: int = 512, k: int = 10) -> list[float]:
    """Share of the k nearest neighbours (inside x, by inner product) that the closest 1, 2, 3, ... cells hold, over the first rows of x as queries."""
    q = x[:asked]
    home = nearest_centres(x, centres, 1)[0][:, 0]
    order = nearest_centres(q, centres, len(centres))[0]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], 1)
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    if not near.size:
        return [1.0] * len(centres)
    at = np.take_along_axis(place, home[near], 1).ravel()
    return (np.cumsum(np.bincount(at, minlength=len(centres))) / near.size).round(6).tolist()


def _placed(rows: DataFrame, id_col: str, v: str, centres: np.ndarray, many: int) -> DataFrame:
    """(id, v) -> (id, v, cell) for the ``many`` closest cells of each vector."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # most_cells x dimension doubles

    def place(batches):
        for batch in batches:
            rows = max(1, PLACED_ROWS // many)  # a row goes out once for each of its cells
            for a in range(0, batch.num_rows, rows):
                own = batch.slice(a, rows)
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                cells, _ = nearest_centres(x, sent.value, many)
                each = pa.array(np.repeat(np.arange(own.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([own.column(0).take(each), own.column(1).take(each), pa.array(cells.ravel(), pa.int32())], names=[id_col, v, "cell"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(v).cast("array<double>").alias(v)).mapInArrow(place, f"{id_col} long, {v} array<double>, cell int")


def _write_part(index: CellIndex, vectors: DataFrame | None, removed: DataFrame | None) -> dict:
    spark, name = index.spark, uuid.uuid4().hex
    at = f"{index.folder}/parts/{name}"
    part = {"name": name, "place": index.parts[-1]["place"] + 1 if index.parts else 0, "cells": {}, "removed": 0}
    if vectors is not None and len(index.centres):
        _placed(_usable(vectors, index.centres.shape[1]), "vec_id", "embedding", index.centres, 1).write.parquet(f"{at}/work")
        work = spark.read.parquet(f"{at}/work")
        counts = {r["cell"]: r["count"] for r in work.groupBy("cell").count().collect()}  # a row for each cell
        files = spark.createDataFrame([(c, -(-n // FILE_ROWS)) for c, n in counts.items()], "cell int, files long")
        dealt = work.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("vec_id"), F.col("files")))  # a large cell goes to several tasks
        dealt.repartition("cell", "file").drop("files", "file").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(f"{at}/vectors")
        part["cells"] = {str(c): n for c, n in counts.items()}
        path, fs = versions._files(spark, f"{at}/work")
        fs.delete(path, True)
    if removed is not None:
        removed.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct().write.parquet(f"{at}/removed")
        part["removed"] = spark.read.schema("vec_id long").parquet(f"{at}/removed").count()
    return part


def build(spark: SparkSession, folder: str, vectors: DataFrame, cells: int | None = None, fit_rows: int = 20_000, most_cells: int = 4096) -> CellIndex:
    """A new version of the index over these vectors alone; about the square root of their number as cells, unless given.

    The dimension is that of most usable vectors.
    """
    lengths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("dims")).count().where("dims > 0")
    common = lengths.orderBy(F.desc("count"), "dims").first()
    number, _ = versions.latest(spark, folder) or (0, None)
    centres, curve = np.zeros((0, 0)), []
    if common is not None:
        usable = _usable(vectors, common["dims"])
        sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("embedding").toArrow().column(0).combine_chunks()
        if len(sample):
            x = np.array(sample.flatten()).reshape(len(sample), -1)
            centres = fit_centres(x, min(most_cells, cells or math.isqrt(common["count"]) + 1))
            curve = recall_curve(x, centres)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{folder}/centres/{number + 1}")
    empty = CellIndex(spark, folder, number, centres, (), tuple(curve))
    return _publish(empty, [_write_part(empty, vectors, None)], number + 1)


def _publish(index: CellIndex, parts: list[dict], centres: int | None = None) -> CellIndex:
    if centres is None:
        centres = versions.latest(index.spark, index.folder)[1]["centres"]
    versions.publish(index.spark, index.folder, index.version + 1, {"centres": centres, "parts": parts, "curve": index.curve})
    return CellIndex(index.spark, index.folder, index.version + 1, index.centres, tuple(parts), index.curve)


def open_cells(spark: SparkSession, folder: str) -> CellIndex:
    """The newest version in a folder."""
    found = versions.latest(spark, folder)
    if found is None:
        raise ValueError(f"no index in {folder}")
    number, content = found
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{folder}/centres/{content['centres']}").orderBy("cell").collect()  # most_cells rows
    return CellIndex(spark, folder, number, np.array([r["centre"] for r in rows]).reshape(len(rows), -1), tuple(content["parts"]), tuple(content["curve"]))


def change(index: CellIndex, add: DataFrame | None = None, remove: DataFrame | None = None) -> CellIndex:
    """The next version: vectors of the ids in ``remove`` (vec_id) go, those in ``add`` come."""
    if add is None and remove is None:
        return index
    return _publish(index, [*index.parts, _write_part(index, add, remove)])


def probed(index: CellIndex, query: list[float], probes: int) -> list[int]:
    """The cells that a query looks into."""
    if not len(index.centres) or len(query) != index.centres.shape[1]:
        return []
    return nearest_centres(np.array([query], np.float64), index.centres, probes)[0][0].tolist()


def search(index: CellIndex, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """(vec_id, score, rank) of the k closest vectors in the ``probes`` closest cells (those for a recall of 0.97, unless given); other cells are not read."""
    probes = probes or index.probes_for(RECALL)
    return V.knn(index.rows(probed(index, query, probes)), query, k)


def search_batch(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, block_rows: int = 1024, batch_queries: int = 512) -> DataFrame:
    """(query_id, vec_id, score, rank) for each of the queries (query_id, q), each in its own ``probes`` closest cells (as ``search``).

    Queries and vectors of a cell meet in blocks, so a cell with very many of either is the work of many tasks.
    """
    empty = queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    sizes = index.sizes()
    if not sizes:
        return empty
    q = F.col("q")
    ok = q.isNotNull() & F.col("query_id").isNotNull() & (F.size(q) == index.centres.shape[1]) & F.forall(q, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    asked = _placed(queries.where(F.coalesce(ok, F.lit(False))), "query_id", "q", index.centres, probes or index.probes_for(RECALL))
    of_cell = index.spark.createDataFrame([(c, -(-n // block_rows)) for c, n in sizes.items()], "cell int, many int")
    v = index.rows().join(F.broadcast(of_cell), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("many")).cast("int"))
    blocks = v.groupBy("cell", "block").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))).alias("blocks"))
    per_cell = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / batch_queries).cast("int").alias("lots"))
    packed = asked.join(F.broadcast(per_cell), "cell").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int"))
    packed = packed.groupBy("cell", "lot").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("q").alias("v"))).alias("batchs"))
    pairs = per_cell.join(F.broadcast(of_cell), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "many")
    pairs = pairs.select("cell", "lot", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"))
    tasks = pairs.join(packed, ["cell", "lot"]).join(blocks, ["cell", "block"])
    batch = (F.col("cell").cast("long") * 2**31 + F.col("lot")).alias("batch")
    return V.nearest_of_blocks(tasks.select(batch, F.lit(index.centres.shape[1]).alias("width"), "blocks", "batchs"), k)
