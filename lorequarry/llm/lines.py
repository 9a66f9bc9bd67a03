"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

1. Every task sets the two bits of each of its lines in a first filter, and bits that it meets again in a second one.  The filters
   are cut into chunks; a chunk of all tasks is merged at one place (what two first filters share goes to the second).
   The size of a filter follows the corpus up to a fixed bound, so it may be broadcast; beyond the bound more lines are
   merely suspected.
2. Only lines of which the second filter holds both bits are shuffled, with their whole keys, for exact counts of documents and
   the choice of the one that keeps the line.
3. The dropped line numbers of each document meet its text, and the other lines are joined again.

Defined cases: a null or empty text is one empty line; lines shorter than ``min_chars`` are never dropped; a line that
stands several times in the keeping document stays there each time; rows that share a doc_id count as one document, and each loses its own
lines only, whatever its siblings hold;
rows with a null doc_id are left as they are and count for nothing; an empty table gives no rows; columns other than
doc_id and text pass through, but columns of docs called n_lines, n_dropped or kept are replaced.  doc_id must be a
number or its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.durable import durable, small_side
from lorequarry.llm.textbytes import LOWER, SPACE, mix, prefix_sums, slices, substring_hash

CHUNK_BYTES = 1 << 16
HOT_DOCS = 10_000  # there are at most lines / HOT_DOCS hot lines


def line_spans(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """(text, line number, start, end) of the stripped lines with at least so many code points."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([offsets[1:], breaks]))
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    keep = b > a  # empty lines go, and with them those that begin where their text ends
    a, b, start = a[keep], b[keep], start[keep]
    owner = np.searchsorted(offsets, start, "right") - 1
    number = np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets[owner])
    s, e = solid[a], solid[b - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[e] - points[s] >= min_chars
    return owner[long], number[long], s[long], e[long]


def bit_places(h: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each hash in a filter of so many bits, 2 x hashes."""
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, mix(h, 5) & mask]).astype(np.int64)


def _hashed_lines(column, min_chars: int):
    for first, data, offsets in slices(column):
        data = LOWER[data]
        owner, number, start, end = line_spans(data, offsets, min_chars)
        yield first, data, owner, number, start, end, substring_hash(prefix_sums(data), start, end)


def second_filter(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(chunk, bytes): the bits that two lines or more have set; false positives only.

    A task's filters travel as sorted bit positions inside their chunk, which is smaller than bitmaps as long as they are
    sparse; a full chunk travels as its bitmap.
    """
    chunk_bits = CHUNK_BYTES * 8
    few = CHUNK_BYTES // 4

    def build(batches):
        met = [np.zeros(0, np.int64)]
        for batch in batches:
            for *_, h in _hashed_lines(batch.column(0), min_chars):
                met.append(bit_places(h, bits).reshape(-1))
        values, counts = np.unique(np.concatenate(met), return_counts=True)
        chunks, kinds, raw = [], [], []
        for kind, have in enumerate((values, values[counts > 1])):
            cuts = np.searchsorted(have, np.arange(0, bits + chunk_bits, chunk_bits))
            for c in np.flatnonzero(np.diff(cuts)).tolist():
                part = (have[cuts[c] : cuts[c + 1]] - c * chunk_bits).astype("<u4")
                chunks.append(c)
                if len(part) > few:
                    full = np.zeros(chunk_bits, bool)
                    full[part] = True
                    kinds.append(kind + 2)
                    raw.append(np.packbits(full).tobytes())
                else:
                    kinds.append(kind)
                    raw.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(kinds, pa.int32()), pa.array(raw, pa.binary())], names=["chunk", "kind", "raw"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(chunk_bits, bool)
        twice = np.zeros(chunk_bits, bool)
        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if kind & 2 else np.frombuffer(raw, "<u4")
                if kind & 1:
                    twice[at] = True
                else:
                    twice[at[once[at]]] = True
                    once[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["chunk", "bits"])

    parts = docs.select("text").mapInArrow(build, "chunk int, kind int, raw binary")
    return parts.groupBy("chunk").applyInArrow(merge, "chunk int, bits binary")


def text_tag() -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def filter_bits(docs: DataFrame, most_bits: int) -> int:
    """A power of two of about 16 bits for each line, at most ``most_bits``."""
    lines = docs.select(F.sum(F.regexp_count(F.col("text"), F.lit("\n")) + 1).alias("n")).first()["n"] or 0
    wanted = max(CHUNK_BYTES * 8, 16 * lines)
    return min(most_bits, 1 << (wanted - 1).bit_length())


def suspected_lines(docs: DataFrame, min_chars: int, most_bits: int) -> DataFrame:
    """(doc_id, tag, line, key) of lines that may stand elsewhere too; tag tells the texts of a doc_id apart."""
    spark = docs.sparkSession
    bits = filter_bits(docs, most_bits)
    held = np.zeros(bits // 8, np.uint8)  # bounded by most_bits
    for row in second_filter(docs, min_chars, bits).toLocalIterator():
        held[row["chunk"] * CHUNK_BYTES : (row["chunk"] + 1) * CHUNK_BYTES] = np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(held)

    def probe(batches):
        filter_ = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, owner, number, start, end, h in _hashed_lines(batch.column(2), min_chars):
                at = bit_places(h, bits)
                hit = np.flatnonzero(((filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0))
                raw = data.tobytes()
                keys = [raw[a:b].decode() for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + owner[hit]], pa.int64()), pa.array(tags[first + owner[hit]], pa.int64()), pa.array(number[hit].astype(np.int32)), pa.array(keys, pa.string())],
                    names=["doc_id", "tag", "line", "key"],
                )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_tag().alias("tag"), "text").mapInArrow(probe, "doc_id long, tag long, line int, key string")


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: str = "largest", most_bits: int = 1 << 29) -> DataFrame:
    """(doc_id, tag, dropped array<int>): the numbers, from 0, of the lines each text loses; texts that lose none have no row.

    ``keep``: whether the largest or the smallest doc_id that holds a line keeps it.
    """
    suspects = durable(suspected_lines(docs, min_chars, most_bits), "lines")
    best = F.max if keep == "largest" else F.min
    # counted in two steps, so that a line of very many documents is summed up in many tasks first
    repeated = suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("keeper"))
    repeated = durable(repeated.where(F.col("n") >= min_docs), "repeated")
    # the few lines of very many documents never meet in one task: they are sent to the suspects
    hot = small_side(repeated.where(F.col("n") > HOT_DOCS).select("key", "keeper"))
    rest = small_side(repeated.where(F.col("n") <= HOT_DOCS).select("key", "keeper"))
    met = suspects.join(hot, "key").unionByName(suspects.join(hot.select("key"), "key", "left_anti").join(rest, "key"))
    return met.where("doc_id <> keeper").groupBy("doc_id", "tag").agg(F.collect_set("line").alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines other than the dropped ones, joined again."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.array_contains(dropped, i))
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text without the dropped lines)."""
    found = dropped_lines(docs, **how).select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), F.col("dropped").alias("__dropped"))
    joined = docs.join(small_side(durable(found, "dropped")), (F.col("doc_id").cast("long") == F.col("__doc")) & (text_tag() == F.col("__tag")), "left")
    n_lines = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("\n")).cast("long") + 1
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")],
        n_lines.alias("n_lines"),
        F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long").alias("n_dropped"),
        kept_text(F.col("text"), F.col("__dropped")).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """docs, the same columns, with the repeated lines gone from the texts; documents left without any text stay, with an empty one.

    n_chars, where there is one, follows the text.
    """
    names = docs.columns
    renamed = {c: f"__own_{c}" for c in ("n_lines", "n_dropped", "kept") if c in names}
    out = dedup_lines(docs.withColumnsRenamed(renamed), **how)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text.alias("text")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[changed.get(c, F.col(f"`{renamed.get(c, c)}`").alias(c)) for c in names])
