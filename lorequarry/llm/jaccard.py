"""N-gram Jaccard join on count vectors kept in R-trees.

Every document is the set of its word shingles, hashed.  The hashes are dealt into groups, and the counts of the groups
are the document's point.  For a similarity t, sets A and B with |A| <= |B| differ in at most D = |A| (1 - t) / t shingles.

1. Routing.  Linked sets share at least |A| t shingles, so each has one of them among its |A| (1 - t) + 1 first ones in any
   order of all shingles.  The order goes by how many documents hold a shingle, as counted over all documents in
   buckets of hashes: rare ones come first, so passages that very many documents share bring nothing together unless they are
   nearly the whole of a document.  The order decides what meets, never what links.  All sets that share such a signature go to the family of the one
   with the smallest hash; families are never joined with each other, so what no document verifies doesn't grow together.
2. R-trees.  A family is cut into pages by running totals of shingles, in order of size; pages whose sizes cannot link do not meet.
   The points of a page are packed into a tree.  The sum over groups of the smaller of two nodes' upper corners bounds
   every overlap between them; pairs of nodes are followed downward, and only pairs of points that may reach the needed
   overlap are left.
3. A task returns few of those: a forest of the likeliest links, and the doubtful pairs between its trees.  They are
   verified on the shingles (by their 64-bit hashes).  Pages are searched within themselves first; pairs of pages only look at
   documents that are not connected yet.
4. Where a link of a forest turns out to be none, or where the doubtful pairs were too many to return, the pair of pages
   is searched again with the shingles themselves, and gives verified spanning links.  So no pair is lost or left out.

Equal sets are one class from the start and enter once, by their smallest doc_id, so copies are never paired.

Defined cases: a null or empty text, or one of white space only, has no shingles and links with nothing; texts of fewer
than k words are one shingle; rows that share a doc_id are one document in links; a null doc_id links with nothing; an
empty table gives no rows; other columns are not read.  doc_id must be a number or its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.components import components
from lorequarry.llm.durable import discard, durable, small_side
from lorequarry.llm.textbytes import mix, ragged, shingle_hashes, slices

COUNT_SLICES = 16  # in so many parts the counts of shingles are summed up


def most_different(size: int, num: int, den: int) -> int:
    """Largest symmetric difference of linked sets of which the smaller has this size; similarity num / den."""
    return size * (den - num) // num


def bucket(u: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, by leading bits; their number is a power of two."""
    return (u >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def signatures(u: np.ndarray, num: int, den: int, often: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set in the order of ``often`` (see ``frequencies``; else by hash); linked sets share one at least."""
    n = len(u)
    least = -(-n * num // den)  # an overlap with any set that links
    if least == n and n * den // num == n:
        return u[:0]  # only equal sets link, and those are one class already
    order = mix(u, 3)
    if often is not None:
        order = (order >> np.uint64(8)) | (often[bucket(u, len(often))].astype(np.uint64) << np.uint64(56))
    return u[np.argpartition(order, n - least)[: n - least + 1]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, h1, h2, point): size of the set, a 128-bit hash of it, and its packed point (two or three bits for each shingle)."""

    def run(batches):
        for batch in batches:
            n, h1, h2, points = [], [], [], []
            for _, data, offsets in slices(batch.column(1)):
                for u in shingle_hashes(data, offsets, k):
                    n.append(len(u))
                    h1.append(int(mix(u, 11).sum()))
                    h2.append(int(mix(u, 13).sum()))
                    points.append(packed(point(u)))
            hashes = (pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *hashes, pa.array(points, pa.binary())], names=["doc_id", "n", "h1", "h2", "point"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, point binary")


def frequencies(docs: DataFrame, k: int, shingles: int) -> np.ndarray:
    """For each bucket of hashes how often documents hold its shingles, in eighths of a power of two (one byte); at most 16 MB.

    There are so many buckets that each has some 16 to 32 of the ``shingles``, as long as those are fewer than 500 million.
    """
    buckets = 1 << int(np.clip(int(shingles // 32).bit_length(), 12, 24))
    part = buckets // COUNT_SLICES

    def count(batches):
        n = np.zeros(buckets, np.uint32)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                for u in shingle_hashes(data, offsets, k):
                    np.add.at(n, bucket(u, buckets), np.uint32(1))
        if n.any():
            planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in np.split(n, COUNT_SLICES)]
            values = [pa.compress(x, "zstd", asbytes=True) for x in planes]
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_SLICES), pa.int32()), pa.array(values, pa.binary())], names=["part", "n"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(part, np.int64)
        for batch in batches:
            for raw in batch.column("n"):
                planes = np.frombuffer(pa.decompress(raw.as_py(), 4 * part, "zstd"), np.uint8).reshape(4, -1)
                n += np.ascontiguousarray(planes.T).view(np.uint32)[:, 0]
        often = np.minimum(255, np.round(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([often.tobytes()], pa.binary())], names=["part", "often"])

    counts = docs.select("text").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(total, "part int, often binary")
    found = counts.toArrow().sort_by("part").column("often").to_pylist()
    return np.frombuffer(b"".join(found), np.uint8) if found else np.zeros(buckets, np.uint8)


def signed(docs: DataFrame, k: int, num: int, den: int, shingles: int) -> DataFrame:
    """(h1, sig): the signatures of each set; a task gives those of equal sets once."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k, shingles))

    def run(batches):
        met = set()  # a number for each document of the task
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                h1, out = [], []
                for u in shingle_hashes(data, offsets, k):
                    h = int(mix(u, 11).sum())
                    if len(u) and h not in met:
                        met.add(h)
                        out.append(signatures(u, num, den, sent.value))
                        h1.append(np.full(len(out[-1]), h, np.uint64))
                if out:  # some hundred signatures a set: handed on with each MB of text
                    columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (h1, out)]
                    yield pa.RecordBatch.from_arrays(columns, names=["h1", "sig"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "h1 long, sig long")


def shingles_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, h1, value binary): the sets of the documents and set hashes (w, h1) that are wanted, once each."""
    wanted = durable(wanted.withColumnRenamed("h1", "w1"), "wanted")
    texts = _texts(docs).join(small_side(wanted), F.col("doc_id") == F.col("w"))

    def run(batches):
        for batch in batches:
            want = batch.column("w1").to_numpy().view(np.uint64)
            row, keep, out = 0, [], []
            for _, data, offsets in slices(batch.column("text")):
                for u in shingle_hashes(data, offsets, k):
                    if mix(u, 11).sum() == want[row]:  # of rows that share a doc_id, those whose set is wanted
                        keep.append(row)
                        out.append(u.tobytes())
                    row += 1
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("w1").take(at), pa.array(out, pa.binary())], names=["doc_id", "h1", "value"])

    found = texts.select("doc_id", "w1", "text").mapInArrow(run, "doc_id long, h1 long, value binary")
    return durable(found.dropDuplicates(["doc_id", "h1"]), "shingles")


def needed_overlap(a, b, num: int, den: int):
    """Smallest overlap that links sets of sizes a and b: overlap / (a + b - overlap) >= num / den."""
    return -(-(a + b) * num // (num + den))


def point(u: np.ndarray) -> np.ndarray:
    """Counts of the groups of a set: the low bits of a hash are its group, so halves of a point add up to a coarser one."""
    groups = 1 << int(np.clip(len(u), 64, 16384) - 1).bit_length()
    counts = np.bincount((u & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("<u1") if counts.max(initial=0) < 256 else counts.astype("<u4")


def packed(counts: np.ndarray) -> bytes:
    """A point as bytes: each count as so many 0 bits and a 1, which is a bit for each shingle and each group."""
    bits = np.zeros(len(counts) + int(counts.sum(dtype=np.int64)), np.uint8)
    bits[np.cumsum(counts, dtype=np.int64) + np.arange(len(counts))] = 1
    return np.packbits(bits).tobytes()


def unpacked(raws: list[bytes]) -> list[np.ndarray]:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(raws), np.uint8)))
    begin = 8 * np.cumsum([0, *map(len, raws)])[:-1]
    first = np.searchsorted(ends, begin)
    counts = np.diff(ends, prepend=-1) - 1
    counts[first] = ends[first] - begin  # the bits left over of the point before do not count
    return np.split(narrow(counts), first[1:])


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points over fewer groups."""
    if points.shape[-1] == groups:
        return points
    return points.reshape(*points.shape[:-1], -1, groups).sum(-2, dtype=np.int64)


def narrow(points: np.ndarray) -> np.ndarray:
    most = int(points.max(initial=0))
    return points.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64)


class RTree:
    """Points packed into nodes; levels[0] holds the points themselves as (upper corners, smallest sizes, first child)."""

    LEAF, FAN = 8, 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        coarse = narrow(folded(points, min(64, points.shape[1])))
        # sort-tile packing: by size, then inside each tile by the coordinate that varies most
        self.order = np.argsort(sizes, kind="stable")
        tile = self.LEAF * max(1, int(np.sqrt(len(sizes) / self.LEAF)))
        for a in range(0, len(sizes), tile):
            own = self.order[a : a + tile]
            self.order[a : a + tile] = own[np.argsort(coarse[own, coarse[own].var(0).argmax()], kind="stable")]
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(coarse[self.order], self.sizes, np.arange(len(sizes)))]
        while len(self.levels[-1][0]) > 1:
            high, small, _ = self.levels[-1]
            first = np.arange(0, len(small), self.LEAF if len(self.levels) == 1 else self.FAN)
            self.levels.append((np.maximum.reduceat(high, first, axis=0), np.minimum.reduceat(small, first), first))


def rtree_pairs(left: RTree, right: RTree, num: int, den: int, run: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bound) of the pairs of points whose overlap bound reaches what they need; i < j in order where both trees are one.

    So many pairs of nodes are looked at together: each has up to 64 pairs of children, and a pair of points takes some KB.
    """
    same = left is right
    depth = max(len(left.levels), len(right.levels)) - 1
    level = lambda t, d: min(d, len(t.levels) - 1)

    def may(t: np.ndarray, u: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray):
        bound = np.minimum(np.minimum(t[a], u[b]).sum(1, dtype=np.int64), np.minimum(n[a], m[b]) if t is left.points else np.iinfo(np.int64).max)
        return bound, bound >= needed_overlap(n[a], m[b], num, den)

    def down(d: int, x: np.ndarray, y: np.ndarray):
        for at in range(0, len(x), run):
            a, b = x[at : at + run], y[at : at + run]
            (high1, small1, _), (high2, small2, _) = left.levels[level(left, d)], right.levels[level(right, d)]
            keep = may(high1, high2, a, b, small1, small2)[1]
            a, b = a[keep], b[keep]
            if d == 0:
                if len(a):
                    bound, keep = may(left.points, right.points, a, b, left.sizes, right.sizes)
                    yield left.order[a[keep]], right.order[b[keep]], bound[keep]
                continue
            (a, more), (b, other) = _children(left, a, d), _children(right, b, d)
            times = np.repeat(other, more)  # children of the left node meet all children of the right one
            i = np.repeat(_ragged(a, more), times)
            j = _ragged(np.repeat(b, more), times)
            if same:
                fits = i < j if d == 1 else i <= j
                i, j = i[fits], j[fits]
            yield from down(d - 1, i, j)

    yield from down(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))


def _children(tree: RTree, nodes: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(first child, number of children) a level below d; a tree that has no such level keeps its root."""
    if d >= len(tree.levels):
        return nodes, np.ones(len(nodes), np.int64)
    first = np.append(tree.levels[d][2], len(tree.levels[d - 1][0]))
    return first[nodes], first[nodes + 1] - first[nodes]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return ragged(np.asarray(starts), np.asarray(lengths))


class Forest:
    """Union-find over 0 .. m - 1."""

    def __init__(self, m: int, same: np.ndarray | None = None):
        self.root = list(range(m))
        if same is not None:  # those of one component from the start
            _, first, back = np.unique(same, return_index=True, return_inverse=True)
            self.root = first[back].tolist()

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, a: int, b: int) -> bool:
        x, y = self.top(a), self.top(b)
        self.root[max(x, y)] = min(x, y)
        return x != y

    def tops(self) -> np.ndarray:
        return np.array([self.top(i) for i in range(len(self.root))])


def trees(points: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None) -> tuple[RTree, RTree, np.ndarray, np.ndarray]:
    """(left tree, right tree, rows of the left one, rows of the right one); one tree where there are no sides."""
    groups = min(len(p) for p in points)
    flat = narrow(np.stack([folded(p, groups) for p in points]))
    if side is None:
        t, rows = RTree(flat, sizes), np.arange(len(sizes))
        return t, t, rows, rows
    low, high = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
    return RTree(flat[low], sizes[low]), RTree(flat[high], sizes[high]), low, high


def likely_links(points: list[np.ndarray], sizes: np.ndarray, same: np.ndarray, side: np.ndarray | None, num: int, den: int, doubt: float = 0.03) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(forest, doubtful pairs, whether there were too many of them): what the points alone say of the links between components.

    The forest is built from the pairs that are likeliest to link; of those near the needed similarity, each is returned
    whose ends the forest doesn't connect, unless there are more than 8 for a document.
    """
    if side is not None and side.min() == side.max():
        return [], [], False
    left, right, rows, cols = trees(points, sizes, side)
    forest = Forest(len(sizes), same)
    got, near = [], []
    label = forest.tops()
    for i, j, bound in rtree_pairs(left, right, num, den):
        i, j = rows[i], cols[j]
        new = label[i] != label[j]
        i, j, bound = i[new], j[new], bound[new]
        likely = bound / (sizes[i] + sizes[j] - bound) >= num / den + doubt * (1 - num / den)
        before = len(got)
        for a, b in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
            if forest.join(a, b):
                got.append((a, b))
        if len(got) > before:
            label = forest.tops()
        near.append(np.stack([i[~likely], j[~likely]]))
        if sum(x.shape[1] for x in near) > 16 * len(sizes):  # those that have been connected meanwhile go
            near = [x[:, label[x[0]] != label[x[1]]] for x in near]
            if sum(x.shape[1] for x in near) > 8 * len(sizes):
                return got, [], True
    open_ = np.concatenate(near, axis=1) if near else np.zeros((2, 0), np.int64)
    open_ = open_[:, label[open_[0]] != label[open_[1]]]
    return (got, [], True) if open_.shape[1] > 8 * len(sizes) else (got, list(zip(*open_.tolist(), strict=True)), False)


def family_links(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int, same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified spanning links among the sets of a family; with ``side`` only pairs of different sides are looked at."""
    if side is not None and side.min() == side.max():
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right, rows, cols = trees([point(s) for s in sets], sizes, side)
    forest, out = Forest(len(sets), same), []
    for i, j, bound in rtree_pairs(left, right, num, den):
        by = np.argsort(-bound, kind="stable")
        for a, b in zip(rows[i[by]].tolist(), cols[j[by]].tolist(), strict=True):
            if forest.top(a) == forest.top(b):
                continue
            overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if overlap * den >= num * (len(sets[a]) + len(sets[b]) - overlap):
                forest.join(a, b)
                out.append((a, b))
    return out


def paged(sized: DataFrame, num: int, den: int, page_shingles: int, docs_per_bucket: int = 500, bin_shingles: int = 200_000) -> DataFrame:
    """(node, component, n, h1, h2) -> (__doc, h1, h2, n, component, page, bin, meets): the pages of families, and the pairs of pages that a document meets in.

    Families of at most ``page_shingles`` are one page, and share bins of ``bin_shingles`` or so.  A larger one is put in
    order of size class and hash, and cut by running totals: a page starts no document after its ``page_shingles`` are reached.
    The totals are summed in two steps (inside a bucket, then over buckets), so that no task orders a family.
    """
    bins = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // min(page_shingles, bin_shingles)))
    totals = sized.groupBy("component").agg(F.sum("n").alias("total"))
    large = durable(totals.where(F.col("total") > page_shingles).select("component"), "large")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    small = sized.join(large, "component", "left_anti").select(F.col("node").alias("__doc"), "h1", "h2", "n", "component", F.lit(0).alias("page"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"), whole.alias("meets"))

    own = sized.join(large, "component").withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05)))).withColumn("at", F.xxhash64("node"))
    counts = own.groupBy("component", "size_class").agg(F.ceil(F.count(F.lit(1)) / docs_per_bucket).cast("long").alias("buckets"))
    own = own.join(small_side(durable(counts, "counts")), ["component", "size_class"]).withColumn("bucket", F.floor(F.shiftrightunsigned("at", 33) / F.lit(2.0**31) * F.col("buckets")).cast("long"))
    own = durable(own, "buckets")
    key = ["component", "size_class", "bucket"]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    offsets = own.groupBy(*key).agg(F.sum("n").alias("in_bucket"))
    offsets = offsets.withColumn("offset", F.sum("in_bucket").over(before(Window.partitionBy("component").orderBy("size_class", "bucket"))) - F.col("in_bucket")).drop("in_bucket")
    inside = F.sum("n").over(before(Window.partitionBy(*key).orderBy("at", "node"))) - F.col("n")
    own = own.withColumn("inside", inside).join(offsets, key).withColumn("page", F.floor((F.col("offset") + F.col("inside")) / page_shingles).cast("int"))
    own = durable(own.select("node", "h1", "h2", "component", "n", "page"), "cut")
    # sets link only where the smaller has num / den of the larger's size, so pages of unlike sizes do not meet
    ranges = own.groupBy("component", "page").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = ranges.select(F.col("component").alias("c2"), F.col("page").alias("p2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    near = (F.col("component") == F.col("c2")) & (F.col("most") * den >= F.col("least2") * num) & (F.col("most2") * den >= F.col("least") * num)
    meets = ranges.join(other, near).groupBy("component", "page").agg(F.collect_list(F.struct(F.least("page", "p2").alias("lo"), F.greatest("page", "p2").alias("hi"))).alias("meets"))
    cut = own.join(meets, ["component", "page"]).select(F.col("node").alias("__doc"), "h1", "h2", "n", "component", "page", F.lit(-1).cast("long").alias("bin"), "meets")
    return small.unionByName(cut)


def _task_rows(members: DataFrame, values: DataFrame, component: DataFrame | None) -> DataFrame:
    """Members (with pair) joined with their values and components, and dealt to tasks."""
    v = values.select(F.col("doc_id").alias("v"), F.col("h1").alias("v1"), "value")
    rows = members.join(v, (F.col("__doc") == F.col("v")) & (F.col("h1") == F.col("v1")))
    if component is None:
        rows = rows.withColumn("at", F.col("__doc"))
    else:
        c = component.select(F.col("node").alias("c"), F.col("component").alias("c2"))
        rows = rows.join(c, F.col("__doc") == F.col("c"), "left").withColumn("at", F.coalesce("c2", "__doc"))
    task = F.when(F.col("bin") >= 0, F.xxhash64("bin")).otherwise(F.xxhash64("family", "pair.lo", "pair.hi"))
    return rows.select(task.alias("task"), "family", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "page", F.col("__doc").alias("doc_id"), "h1", "n", "at", "value")


def _families(search):
    """search(rows of a family as columns) for each family of a task, as a function for applyInArrow."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("family", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("doc_id", "ascending")])
        family = table.column("family").to_numpy()
        cuts = np.flatnonzero(np.diff(family, prepend=family[0] - 1, append=family[-1] + 1))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                part = table.slice(a, b - a)
                lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
                side = part.column("page").to_numpy() if lo != hi else None
                got = search(part, part.column("n").to_numpy(), part.column("at").to_numpy(), side)
                ids, h1 = part.column("doc_id").to_numpy(), part.column("h1").to_numpy()
                out += [(int(family[a]), lo, hi, int(ids[x]), int(h1[x]), int(ids[y]), int(h1[y]), kind) for x, y, kind in got]
        columns = list(zip(*out, strict=True)) or [[]] * 8
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=LINK_COLUMNS)

    return run


LINK_COLUMNS = ["family", "lo", "hi", "a", "a1", "b", "b1", "kind"]
LINKS = "family long, lo int, hi int, a long, a1 long, b long, b1 long, kind int"
FOREST, DOUBTFUL, TOO_MANY = 0, 1, 2


def _by_points(num: int, den: int):
    def search(part, sizes, at, side):
        points = unpacked(part.column("value").to_pylist())
        forest, near, too_many = likely_links(points, sizes, at, side, num, den)
        return [(a, b, FOREST) for a, b in forest] + [(a, b, DOUBTFUL) for a, b in near] + [(0, 0, TOO_MANY)] * too_many

    return _families(search)


def _by_sets(num: int, den: int):
    def search(part, sizes, at, side):
        sets = [np.frombuffer(raw, np.uint64) for raw in part.column("value").to_pylist()]
        return [(a, b, FOREST) for a, b in family_links(sets, side, num, den, at)]

    return _families(search)


def verified(docs: DataFrame, links: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """links with ok: whether the sets of their ends reach the similarity."""
    pairs = links.where(F.col("kind") != TOO_MANY).select("a", "a1", "b", "b1").distinct()
    ends = pairs.select(F.col("a").alias("w"), F.col("a1").alias("h1")).unionByName(pairs.select(F.col("b").alias("w"), F.col("b1").alias("h1"))).distinct()
    sets = shingles_of(docs, ends, k)
    of = lambda d, h, x: sets.select(F.col("doc_id").alias(d), F.col("h1").alias(h), F.col("value").alias(x))
    both = pairs.join(of("a", "a1", "x"), ["a", "a1"]).join(of("b", "b1", "y"), ["b", "b1"])

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):  # one pair is copied at a time
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(overlap * den >= num * (len(x) + len(y) - overlap))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "a1", "b", "b1")), pa.array(ok, pa.bool_())], names=["a", "a1", "b", "b1", "ok"])

    checked = both.select("a", "a1", "b", "b1", "x", "y").mapInArrow(compare, "a long, a1 long, b long, b1 long, ok boolean")
    out = durable(links.join(checked, ["a", "a1", "b", "b1"], "left"), "checked")
    discard(sets)
    return out


def rounds_of(pairs: DataFrame, times: int) -> int:
    """In how many rounds pairs of pages meet, so that a round ships about ``times`` what the pages themselves hold."""
    sums = pairs.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(x) for x, c in (("own", F.expr("pair.lo = pair.hi")), ("across", F.expr("pair.lo < pair.hi")))]).first()
    return -(-sums["across"] // max(1, times * sums["own"]))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, page_shingles: int = 200_000, times: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: size of the set, and smallest doc_id reachable by links.

    A page of ``page_shingles`` is about as many bytes of points once unpacked, so a task holds some MB; a set of a large family is shipped once for each of
    its pages, so that larger pages are shipped less.  Pairs of pages meet in rounds, and what a round shipped is released before the next one.
    """
    rows = durable(shingled(docs, k), "sets")
    linkable = rows.where("n > 0 and doc_id is not null")
    one = durable(linkable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n")).alias("s")).select("h1", "h2", "s.*"), "classes")

    # sets that share a signature go to the family of the one with the smallest hash
    sigs = signed(docs, k, num, den, linkable.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    in_order = Window.partitionBy("sig").orderBy("h1").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a running first needs no memory for hot signatures
    shared = sigs.withColumn("family", F.first("h1").over(in_order)).where("family <> h1").select("family", "h1").distinct()
    shared = durable(shared, "shared")
    met = shared.unionByName(shared.select("family", F.col("family").alias("h1")).distinct())
    sized = durable(met.join(one.select("h1", "h2", "n", F.col("doc_id").alias("node")), "h1").select("family", "node", "n", "h1", "h2"), "families")
    discard(shared)
    members = durable(paged(sized.withColumnRenamed("family", "component"), num, den, page_shingles).withColumnRenamed("component", "family"), "pages")
    of_members = sized.select(F.col("node").alias("w"), F.col("h1").alias("w1"), F.col("h2").alias("w2")).distinct()
    points = rows.join(small_side(durable(of_members, "wanted")), (F.col("doc_id") == F.col("w")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")))
    points = durable(points.select("doc_id", "h1", F.col("point").alias("value")).dropDuplicates(["doc_id", "h1"]), "points")
    pairs = members.withColumn("pair", F.explode("meets")).drop("meets", "h2")

    own = pairs.where("pair.lo = pair.hi")
    first = verified(docs, durable(_task_rows(own, points, None).groupBy("task").applyInArrow(_by_points(num, den), LINKS), "links"), k, num, den)
    linked = components(first.where("ok").select("a", "b"))
    links = first
    rounds = rounds_of(pairs, times)
    if rounds:
        across = pairs.where("pair.lo < pair.hi")
        met = [across.where(F.pmod(F.xxhash64("family", "pair.lo", "pair.hi"), F.lit(rounds)) == i) for i in range(rounds)]
        met = [durable(_task_rows(m, points, linked).groupBy("task").applyInArrow(_by_points(num, den), LINKS), "links") for m in met]
        second = verified(docs, reduce(DataFrame.unionByName, met), k, num, den)
        links = first.unionByName(second)
        linked = components(links.where("ok").select("a", "b"))
    # what the points left open is searched again with the sets
    again = durable(links.where((F.col("kind") == TOO_MANY) | ((F.col("kind") == FOREST) & ~F.col("ok"))).select("family", "lo", "hi").distinct(), "again")
    if not again.isEmpty():
        open_ = pairs.join(again, (pairs["family"] == again["family"]) & (F.col("pair.lo") == again["lo"]) & (F.col("pair.hi") == again["hi"]), "left_semi")
        sets = shingles_of(docs, open_.select(F.col("__doc").alias("w"), "h1").distinct(), k)
        third = durable(_task_rows(open_, sets, linked).groupBy("task").applyInArrow(_by_sets(num, den), LINKS), "links")
        discard(sets)
        linked = components(links.where("ok").select("a", "b").unionByName(third.select("a", "b")))
    for t in (sized, members, points):
        discard(t)
    found = linked.select(F.col("node").alias("rep"), "component")
    # every row with its class, every class with its component
    classes = one.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("doc_id").alias("rep")).join(found, "rep", "left")
    classes = classes.select("k1", "k2", F.coalesce("component", "rep").alias("class"))
    joined = rows.drop("point").join(classes, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, **how) -> DataFrame:
    """The documents that stand for their group of near-duplicates (the smallest doc_id), all columns; others go.

    A doc_id that holds unlike texts stays with all of them, as one may repeat nowhere.
    """
    groups = jaccard_components(docs, **how)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    unlike = docs.groupBy(F.col("doc_id").cast("long").alias("__gone")).agg(F.min(tag).alias("lo"), F.max(tag).alias("hi")).where("lo <> hi")
    gone = gone.join(unlike, "__gone", "left_anti")
    gone = small_side(durable(gone, "gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
