"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector of each group kept.

The centres are fitted on a bounded sample (``fit_rows``); every vector is then assigned.  Its home is the cell of the
closest centre A, and it is a guest of each other cell whose centre B is closer than the home's plus s |A - B| / 2, where
s = sqrt(2 - 2 threshold) bounds the distance of two linked unit vectors: if u lives in A and v in B, then
v (B - A) + u (A - B) = (v - u) (B - A) <= s |A - B|, both terms on the left are at least 0, and so one of the two is a
guest of the other's home.  No linked pair is lost.  A pair counts in the smallest cell that both belong to.  Cells are taken
inside each label, and large ones are cut into blocks; a task multiplies two blocks.  Tasks return link counts and
spanning links, never all pairs.  Where vectors are so spread that they are guests of most cells, cells multiply more pairs than
there are; those that save less than half of the products on the sample are dropped, and a label is cut into blocks only.

Vectors with the same label and components are one class from the start, and enter the products once.

Defined cases: a vector that is null, zero, or holds null or non-finite components, and one whose label is null, links
with nothing and is kept; vectors of unlike lengths never link; rows that share a vec_id count as vectors each, but are
one node of the components; an empty table gives no rows; other columns are not read.  vec_id must be a number or its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.components import components
from lorequarry.llm.durable import durable


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the norm
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of unit vectors."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def apart(centres: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Distances of the home centres to all centres."""
    squares = (centres * centres).sum(1)
    return np.sqrt(np.maximum(squares[home][:, None] + squares[None] - 2 * (centres[home] @ centres.T), 0))


def guests(u: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each vector, and which cells it is in as resident or guest."""
    near = u @ centres.T
    home = near.argmax(1)
    return home, near >= near.max(1, keepdims=True) - reach * apart(centres, home) - 1e-9


def products(u: np.ndarray, centres: np.ndarray, reach: float) -> float:
    """Products that cells take on these vectors, as a share of those of all pairs."""
    held = sum((guests(u[a : a + 1024], centres, reach)[1].sum(0) for a in range(0, len(u), 1024)), np.zeros(len(centres)))
    return float(((held / max(1, len(u))) ** 2).sum())


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 512, fit_rows: int = 20_000, most_cells: int = 4096, block_rows: int = 4096) -> DataFrame:
    """(vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept) for each row."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists(x, lambda c: c != 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.cast("array<double>").alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))
    one = durable(rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")

    by_size = one.groupBy(F.size("embedding").alias("dims"), "label").count().groupBy("dims").agg(F.max("count").alias("most"), F.sum("count").alias("rows")).orderBy(F.desc("rows")).limit(64).collect()
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) / 2
    centres = {}
    for d in by_size:  # one set of centres for each length of vectors
        sample = one.where(F.size("embedding") == d["dims"]).orderBy(F.xxhash64("node"), "node").limit(fit_rows).select("embedding").toArrow()
        flat = np.array(sample.column(0).combine_chunks().flatten()).reshape(-1, d["dims"])
        found = spherical_kmeans(unit(flat), min(most_cells, -(-d["most"] // cell_rows)))
        if products(unit(flat), found, reach) < 0.5:
            centres[d["dims"]] = found
    sent = one.sparkSession.sparkContext.broadcast(centres)  # most_cells centres at most for each length

    def assign(batches):
        for batch in batches:
            lists = batch.column("embedding")
            lengths = np.diff(np.array(lists.offsets))
            flat, start = np.array(lists.flatten()), np.concatenate([[0], np.cumsum(lengths)])
            cells, raw = [None] * len(lengths), [b""] * len(lengths)
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                u = unit(flat[start[own][:, None] + np.arange(dims)])
                c = sent.value.get(dims)
                home, guest = guests(u, c, reach) if c is not None else (np.zeros(len(own), np.int64), np.ones((len(own), 1), bool))
                for i, r in enumerate(own.tolist()):
                    cells[r] = [int(home[i]), *(g for g in np.flatnonzero(guest[i]).tolist() if g != home[i])]
                    raw[r] = u[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("label"), pa.array(lengths.astype(np.int32)), pa.array(cells, pa.list_(pa.int32())), pa.array(raw, pa.binary())], names=["node", "copies", "label", "dims", "cells", "raw"])

    placed = one.select("node", "copies", "label", "embedding").mapInArrow(assign, "node long, copies long, label string, dims int, cells array<int>, raw binary")
    placed = durable(placed, "cells")
    held = placed.select("node", "copies", "label", "dims", "cells", "raw", F.explode("cells").alias("cell"))
    blocks = held.groupBy("label", "dims", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    held = held.join(blocks, ["label", "dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda p: F.struct(F.least(p, F.col("block")).alias("lo"), F.greatest(p, F.col("block")).alias("hi")))
    held = held.withColumn("pair", F.explode(meets))

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("block", "ascending"), ("node", "ascending")])
        cell, lo, hi = key[2].as_py(), key[3].as_py(), key[4].as_py()
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        cells = table.column("cells").to_pylist()
        u = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(len(node), -1)
        smaller = {c: i for i, c in enumerate(sorted({x for c in cells for x in c if x < cell}))}

        def before(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), len(smaller)), np.float32)
            for i, r in enumerate(rows.tolist()):
                out[i, [smaller[x] for x in cells[r] if x < cell]] = 1
            return out

        links = np.zeros(len(node), np.int64)
        left = np.flatnonzero(block == lo)
        right = np.flatnonzero(block == hi)
        ends: list[np.ndarray] = []
        for a in range(0, len(left), 512):
            i = left[a : a + 512]
            for b in range(0, len(right), 512):
                j = right[b : b + 512]
                if lo == hi and j[-1] <= i[0]:
                    continue
                hit = u[i] @ u[j].T >= threshold
                if lo == hi:
                    hit &= i[:, None] < j[None]
                if not hit.any():
                    continue
                if smaller:
                    hit &= before(i) @ before(j).T == 0  # pairs that share a smaller cell count there
                links[i] += hit @ copies[j]
                links[j] += hit.T @ copies[i]
                ends.append(connecting(hit, i, j))
        pairs = spanning(np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64), len(node))
        touched = np.flatnonzero(links)
        n = len(touched) + pairs.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node[touched], node[pairs[0]]])), pa.array(np.concatenate([np.zeros(len(touched), np.int64), node[pairs[1]]]), mask=np.arange(n) < len(touched)), pa.array(np.concatenate([links[touched], np.zeros(pairs.shape[1], np.int64)]))],
            names=["a", "b", "links"],
        )

    found = held.groupBy("label", "dims", "cell", "pair.lo", "pair.hi").applyInArrow(multiply, "a long, b long, links long")
    found = durable(found, "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    groups = components(found.where("b is not null").select("a", "b"))
    classes = one.join(counts, "node", "left").join(groups, "node", "left")
    classes = classes.select(F.col("label").alias("l2"), F.col("embedding").alias("e2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(classes, F.col("usable") & (F.col("label") == F.col("l2")) & (F.col("embedding") == F.col("e2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def connecting(hit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Few pairs with the components of the hits: each column with its first row, and that row with the column's other rows."""
    cols, rows = np.nonzero(hit.T)
    starts = np.flatnonzero(np.diff(cols, prepend=-1))
    first = np.repeat(rows[starts], np.diff(np.append(starts, len(cols))))
    n = hit.shape[0]
    among = np.unique(first[rows != first] * n + rows[rows != first])
    return np.concatenate([np.stack([i[rows[starts]], j[cols[starts]]]), np.stack([i[among // n], i[among % n]])], axis=1)


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest of the pairs."""
    keep = []
    root = list(range(n))

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for k, (a, b) in enumerate(pairs.T.tolist()):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return pairs[:, keep]
