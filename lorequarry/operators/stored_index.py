"""A stored term index that is kept up by additions and removals, and searched without reading the texts again.

The index is a list of immutable segments.  Each change makes one:

- postings of the added texts in blocks (term, block, ids, tfs, dls), some thousand texts a block, cut and sorted by term, so that a search
  reads the row groups of its terms only; blocks are made where the texts are read, so only they are shuffled, once;
- texts (id, dl, seal) of the added texts, sorted by id; seal is a hash of the text;
- tombstones (id) of the removed texts: they hide postings and texts of that id in segments before their own;
- deltas (term, df): how many texts hold the term more or less than before, also sorted by term.

The number of texts and the sum of their lengths are whole numbers in the manifest, so averages never drift.  Replacing a text is a
removal and an addition in one segment.  ``compact`` merges neighbouring segments, newest first, as long as the older one is not
much larger; others keep their files.

Defined cases: a null id is refused (ValueError), as are ids that are twice in one change, added while they live, or removed while they don't;
a removal whose text differs from the stored one is refused too, as it would spoil the document frequencies.  A null text is empty, counts as a text and
has no terms.  A change without rows writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions.text import terms
from lorequarry.operators.lexical import B, K1, idf
from lorequarry.sources import versions

POSTINGS = "term string, block long, ids array<long>, tfs array<int>, dls array<int>"
TEXTS = "id long, dl long, seal long"
DELTAS = "term string, df long"
BLOCK_WORDS = 1_000_000  # what a task counts at once; some thousand texts
SENT_ROWS = 2_000_000  # tombstones of 8 bytes are sent to all tasks up to here, and shuffled beyond


@dataclass(frozen=True)
class StoredIndex:
    """One version of an index."""

    spark: SparkSession
    folder: str
    version: int
    segments: tuple[dict, ...]  # name, place in order, texts, removed, terms: rows; texts and length: net changes

    @property
    def documents(self) -> int:
        return sum(s["net_texts"] for s in self.segments)

    @property
    def length(self) -> int:
        return sum(s["net_length"] for s in self.segments)

    @property
    def average(self) -> float:
        return self.length / self.documents if self.documents else 0.0

    def table(self, kind: str, schema: str) -> DataFrame:
        """The rows of all segments with ``place``, the order of their segment."""
        own = [s for s in self.segments if s[kind]]
        if not own:
            return self.spark.createDataFrame([], schema + ", place int")
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{s['name']}/{kind}").withColumn("place", F.lit(s["place"])) for s in own]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @property
    def removed(self) -> int:
        return sum(s["tombstones"] for s in self.segments)

    def last_removal(self) -> DataFrame:
        """(__id, __place): the newest tombstone of each removed id."""
        last = self.table("tombstones", "id long").groupBy(F.col("id").alias("__id")).agg(F.max("place").alias("__place"))
        return F.broadcast(last) if self.removed <= SENT_ROWS else last

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows with id and place that no later tombstone hides."""
        if not self.removed:
            return rows
        return rows.join(self.last_removal(), (F.col("id") == F.col("__id")) & (F.col("__place") > F.col("place")), "left_anti")

    def postings(self) -> DataFrame:
        """(term, id, tf, dl) of the live texts."""
        each = self.table("postings", POSTINGS).select("term", "place", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return self.live(each.select("term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), "place")).drop("place")

    def live_blocks(self) -> DataFrame:
        """The blocks of postings, without what tombstones hide."""
        blocks = self.table("postings", POSTINGS)
        if not self.removed:
            return blocks.drop("place")
        if self.removed <= SENT_ROWS:
            rows = self.last_removal().orderBy("__id").toArrow()  # bounded by SENT_ROWS
            sent = self.spark.sparkContext.broadcast((rows.column(0).to_numpy(), rows.column(1).to_numpy()))
            return blocks.select("term", "block", "ids", "tfs", "dls", "place").mapInArrow(_without(sent), POSTINGS)
        each = blocks.select("term", "block", "place", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).withColumn("id", F.col("p.ids"))
        kept = self.live(each).groupBy("term", "block", "place").agg(F.sort_array(F.collect_list("p")).alias("p"))
        return kept.select("term", "block", *[F.col(f"p.{c}").alias(c) for c in ("ids", "tfs", "dls")])

    def texts(self) -> DataFrame:
        return self.live(self.table("texts", TEXTS)).select("id", "dl", "seal")

    def frequencies(self) -> DataFrame:
        """(term, df), exact; terms that no text holds any more have no row."""
        return self.table("deltas", DELTAS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def open_index(spark: SparkSession, folder: str) -> StoredIndex:
    """The newest version of the index in a folder; an empty one where there is none yet."""
    number, content = versions.latest(spark, folder) or (0, {"segments": []})
    return StoredIndex(spark, folder, number, tuple(content["segments"]))


def _counted(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = terms(F.coalesce(F.col(text_col), F.lit("")))
    return texts.select(F.col(id_col).cast("long").alias("id"), words.alias("words"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("seal"))


def _without(sent):
    """Blocks without the postings whose id has a later tombstone."""

    def keep(batches):
        gone, until = sent.value
        for b in batches:
            lists = b.column("ids")
            sizes = np.diff(np.array(lists.offsets))
            ids = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(gone, ids), len(gone) - 1)
            left = ~((gone[at] == ids) & (until[at] > np.repeat(b.column("place").to_numpy(), sizes)))
            ends = np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            some = pa.array(np.flatnonzero(np.diff(ends) > 0))
            cut = [pa.ListArray.from_arrays(pa.array(ends), b.column(c).flatten().filter(pa.array(left))) for c in ("ids", "tfs", "dls")]
            yield pa.RecordBatch.from_arrays([c.take(some) for c in (b.column("term"), b.column("block"), *cut)], names=["term", "block", "ids", "tfs", "dls"])

    return keep


def _slices(batches: Iterator[pa.RecordBatch], most: int = BLOCK_WORDS) -> Iterator[pa.RecordBatch]:
    """The same texts in batches of at most so many words (or one text), so that a block takes the same memory whatever the batches hold."""
    for b in batches:
        ends = np.array(b.column("words").offsets, np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _blocks(counted: DataFrame) -> DataFrame:
    """(id, words) -> blocks of postings: a task counts the words of some thousand texts at once, and hands on a row for each of their terms."""

    def count(batches):
        for number, b in enumerate(_slices(batches)):
            lists = b.column("words")
            offsets = np.array(lists.offsets, np.int64)
            offsets -= offsets[0]
            sizes = np.diff(offsets)
            coded = lists.flatten().dictionary_encode()
            n = b.num_rows
            key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
            term, text = key // n if n else key, key % n if n else key
            opens = np.flatnonzero(np.diff(term, prepend=-1))
            cuts = pa.array(np.append(opens, len(term)).astype(np.int32))
            ids = b.column("id").take(pa.array(text))
            columns = [pa.ListArray.from_arrays(cuts, c) for c in (ids, pa.array(tf.astype(np.int32)), pa.array(sizes[text].astype(np.int32)))]
            terms_ = coded.dictionary.take(pa.array(term[opens]))
            yield pa.RecordBatch.from_arrays([terms_, pa.array(np.full(len(opens), number)), *columns], names=["term", "block", "ids", "tfs", "dls"])

    return counted.select("id", "words").mapInArrow(count, POSTINGS)


def _write(df: DataFrame, at: str, key: str) -> None:
    """Rows cut by ranges of the key and sorted in each."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(at)


def _check(problem: DataFrame, what: str) -> None:
    bad = [r[0] for r in problem.limit(5).collect()]  # some ids for the message
    if bad:
        raise ValueError(f"{what}: {bad}")


def change(index: StoredIndex, add: DataFrame | None = None, remove: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> StoredIndex:
    """The next version: texts to remove (with the text that was added) go, then texts to add come; both (id, text)."""
    spark, name = index.spark, f"{len(index.segments):06d}-{uuid.uuid4().hex}"
    at = f"{index.folder}/segments/{name}"
    segment = {"name": name, "place": index.segments[-1]["place"] + 1 if index.segments else 0, "postings": 0, "texts": 0, "tombstones": 0, "deltas": 0, "net_texts": 0, "net_length": 0}
    sides = [(1, _counted(add, id_col, text_col))] if add is not None else []
    sides += [(-1, _counted(remove, id_col, text_col))] if remove is not None else []
    if not sides:
        return index
    for sign, rows in sides:  # tokenised once, read again below
        rows.write.option("compression", "zstd").parquet(f"{at}/work/{'added' if sign > 0 else 'removed'}")
    read = {sign: spark.read.parquet(f"{at}/work/{'added' if sign > 0 else 'removed'}") for sign, _ in sides}
    for rows in read.values():
        _check(rows.where("id is null"), "null ids")
        _check(rows.groupBy("id").count().where("count > 1"), "ids that are twice in one change")
    known = [F.col("id").between(*rows.agg(F.min("id"), F.max("id")).first()) for rows in read.values()]
    within = known[0] if len(known) == 1 else known[0] | known[1]
    stored = index.live(index.table("texts", TEXTS).where(within))  # texts are sorted by id: only row groups of these ranges are read
    gone = read.get(-1)
    if gone is not None:
        _check(gone.join(stored.select("id", F.col("seal").alias("s"), F.lit(True).alias("live")), "id", "left").where("live is null or s <> seal").select("id"), "removed ids that are not stored with this text")
    if 1 in read:
        again = read[1].select("id").join(stored.select("id"), "id", "left_semi")
        _check(again if gone is None else again.join(gone.select("id"), "id", "left_anti"), "added ids that are stored already")
    for sign, rows in read.items():
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        segment["net_texts"] += sign * n
        segment["net_length"] += sign * total
        segment["texts" if sign > 0 else "tombstones"] = n
    if not segment["texts"] and not segment["tombstones"]:
        _delete(spark, at)
        return index
    if segment["texts"]:
        own = read[1]
        _write(_blocks(own), f"{at}/postings", "term")
        _write(own.select("id", F.size("words").cast("long").alias("dl"), "seal"), f"{at}/texts", "id")
        segment["postings"] = spark.read.parquet(f"{at}/postings").count()
    if segment["tombstones"]:
        _write(gone.select("id"), f"{at}/tombstones", "id")
    held = []
    if segment["postings"]:
        held.append(spark.read.schema(POSTINGS).parquet(f"{at}/postings").select("term", F.size("ids").cast("long").alias("n")))
    if segment["tombstones"]:
        held.append(gone.select(F.explode(F.array_distinct("words")).alias("term"), F.lit(-1).cast("long").alias("n")))
    deltas = held[0] if len(held) == 1 else held[0].unionByName(held[1]) if held else spark.createDataFrame([], "term string, n long")
    _write(deltas.groupBy("term").agg(F.sum("n").alias("df")).where("df <> 0"), f"{at}/deltas", "term")
    segment["deltas"] = spark.read.parquet(f"{at}/deltas").count()
    _delete(spark, f"{at}/work")
    return _publish(index, [*index.segments, segment])


def _publish(index: StoredIndex, segments: list[dict]) -> StoredIndex:
    versions.publish(index.spark, index.folder, index.version + 1, {"segments": segments})
    return StoredIndex(index.spark, index.folder, index.version + 1, tuple(segments))


def _delete(spark: SparkSession, at: str) -> None:
    path, files = versions._files(spark, at)
    files.delete(path, True)


def compact(index: StoredIndex, growth: float = 2.0, all_segments: bool = False) -> StoredIndex:
    """Merges the newest segments, going back as long as the next older one has at most ``growth`` times the rows gathered so far.

    So a text is rewritten a number of times that grows with the logarithm of the index only.
    """
    if len(index.segments) < 2:
        return index
    weight = lambda s: s["postings"] + s["texts"] + s["tombstones"]
    first, gathered = len(index.segments) - 1, weight(index.segments[-1])
    while first and (all_segments or weight(index.segments[first - 1]) <= growth * gathered):
        first -= 1
        gathered += weight(index.segments[first])
    merged = index.segments[first:]
    if len(merged) < 2:
        return index
    own = StoredIndex(index.spark, index.folder, index.version, merged)
    name = f"{first:06d}-{uuid.uuid4().hex}"
    at = f"{index.folder}/segments/{name}"
    segment = {"name": name, "place": merged[-1]["place"], "net_texts": own.documents, "net_length": own.length}
    _write(own.live_blocks(), f"{at}/postings", "term")
    _write(own.texts(), f"{at}/texts", "id")
    _write(own.table("deltas", DELTAS).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), f"{at}/deltas", "term")
    if first:  # older segments may hold what these tombstones hide
        _write(own.table("tombstones", "id long").select("id").distinct(), f"{at}/tombstones", "id")
    for kind in ("postings", "texts", "deltas", "tombstones"):
        segment[kind] = index.spark.read.parquet(f"{at}/{kind}").count() if kind != "tombstones" or first else 0
    return _publish(index, [*index.segments[:first], segment])


def clean(index: StoredIndex) -> list[str]:
    """Deletes the segments that this version does not name; no other change may be under way."""
    return versions.drop_unnamed(index.spark, index.folder, "segments", {s["name"] for s in index.segments})


def search(index: StoredIndex, query: str) -> DataFrame:
    """(id, score): BM25 of one query.  The query's terms are pushed down to the scans of postings and deltas; lengths stand in the postings."""
    asked: dict[str, int] = {}
    for r in index.spark.createDataFrame([(query,)], "query string").select(F.explode(terms(F.col("query"))).alias("term")).collect():  # those of one query
        asked[r.term] = asked.get(r.term, 0) + 1
    empty = index.spark.createDataFrame([], "id long, score double")
    if not asked or not index.documents or not index.length:
        return empty
    words = list(asked)
    df = {r.term: r.df for r in StoredIndexView(index, words).frequencies().collect()}  # a row for each term of the query at most
    known = [w for w in words if w in df]
    if not known:
        return empty
    hits = StoredIndexView(index, known).postings()
    weight = F.lit(None).cast("double")
    for w in reversed(known):
        part = idf(F.lit(float(index.documents)), F.lit(float(df[w]))) * F.lit(float(asked[w]))
        weight = F.when(F.col("term") == w, part).otherwise(weight)
    return hits.groupBy("id").agg(F.sum(weight * _saturated(F.col("tf"), F.col("dl"), index.average)).alias("score"))


def _saturated(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


class StoredIndexView(StoredIndex):
    """An index seen through the terms of a query."""

    def __init__(self, index: StoredIndex, words: list[str]):
        super().__init__(index.spark, index.folder, index.version, index.segments)
        object.__setattr__(self, "words", words)

    def table(self, kind: str, schema: str) -> DataFrame:
        rows = super().table(kind, schema)
        return rows.where(F.col("term").isin(self.words)) if schema.startswith("term") else rows
