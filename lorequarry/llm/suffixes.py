"""Exact substring dedup with suffix arrays built by the difference-cover algorithm.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier (in a smaller doc_id, or earlier
in the same document).  Sorting the suffixes of a whole corpus would shuffle many times its size, so the suffixes are
first dealt by content, without losing any match:

1. Anchors.  In every window of ``length`` bytes the gram (GRAM bytes) with the smallest hash is the window's anchor;
   equal windows have equal anchors at equal places.  Anchors, one for some 35 bytes, are counted in Spark.
2. Contexts.  An anchor whose gram stands more than once gets its context: all windows of which it is the anchor.  Equal contexts
   are summed up before the shuffle: the earliest stays, the windows of the others are known to repeat.
3. Suffix arrays.  The contexts of a gram that has several go to one partition, where the difference-cover algorithm sorts their
   suffixes: triples at two of three places are sorted and named, the names are sorted by recursion, the
   remaining suffixes are merged in.  Neighbours that agree in ``length`` bytes form runs, and all windows of a run
   but the earliest repeat.  A gram with more than ``most_contexts`` different contexts is dealt by whole windows.
4. Each document gets its covered bytes as spans, and its text is cut.

Copies of a whole text of ``length`` bytes or more repeat everywhere; all but the smallest doc_id are set aside first.

Defined cases: null is the empty text; texts shorter than ``length`` lose nothing; equal rows of a doc_id are one document, so they all
stay as the first of them does; unlike texts of a doc_id are documents of their own, in an order by hash, and each loses only what
itself repeats; rows with a null doc_id are left as they are and count for nothing; an empty table gives no rows; other columns are
not read.  doc_id must be a number or its text.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.durable import durable, small_side
from lorequarry.llm.textbytes import prefix_sums, ragged, slices, substring_hash

GRAM = 32
SLICE, RUN = 1 << 18, 1 << 18  # bytes that are hashed or sorted at once: their 8-byte temporaries stay near a core


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, place, hash, first window, last window) of the anchors of all windows inside each text.

    The windows of an anchor are consecutive, as the place of the smallest hash never moves back.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none, none
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    h = substring_hash(sums, at, at + GRAM)
    # the last gram with the smallest hash, as the low bits of what is compared hold the place; as many bits in every slice,
    # so that equal windows choose alike wherever they stand
    width = length - GRAM + 1
    bits = np.uint64(31)
    low = np.uint64((1 << 31) - 1)
    keyed = (h >> bits << bits) | (low - at.astype(np.uint64))
    least = sliding_minimum(keyed, width)
    sizes = np.diff(offsets)
    whole = ragged(offsets[:-1], np.maximum(sizes - length + 1, 0))  # windows that stay in their text
    if not len(whole):
        return none, none, none.astype(np.uint64), none, none
    place = (low - (least[whole] & low)).astype(np.int64)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    first, last = whole[starts], whole[np.append(starts[1:], len(whole)) - 1]
    place = place[starts]
    return np.searchsorted(offsets, place, "right") - 1, place, h[place], first, last


def difference_cover_order(text: np.ndarray, enough: int) -> np.ndarray:
    """Ranks of all suffixes of an array of integers >= 1; suffixes that agree in ``enough`` values may share a rank."""
    n = len(text)
    if n < 3:
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        ranks = np.empty(n, np.int64)
        ranks[order] = np.arange(n)
        return ranks
    t = np.concatenate([text.astype(np.int64), [0, 0, 0]])
    size = int(t.max()) + 1
    # sort sampled triples and name them
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    ones = len(sample) - len(range(2, n, 3))
    if size**3 < 2**62:
        triple = (t[sample] * size + t[sample + 1]) * size + t[sample + 2]
    else:
        _, pair = np.unique(t[sample] * size + t[sample + 1], return_inverse=True)
        triple = pair * size + t[sample + 2]
    values, names = np.unique(triple, return_inverse=True)
    # recurse on the names until they differ, or stand for enough values
    if len(values) < len(sample) and enough > 3:
        ranks = difference_cover_order(names + 1, -(-enough // 3))
    else:
        ranks = names
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = ranks + 1
    big = int(rank.max()) + 1
    # the other suffixes by first value and the rank behind it, then merge
    rest = np.arange(0, n, 3)
    rest_key = t[rest] * big + rank[rest + 1]
    s1, s2 = sample[:ones], sample[ones:]
    key1 = t[s1] * big + rank[s1 + 1]
    if size * size * big < 2**62:
        rest_key2 = (t[rest] * size + t[rest + 1]) * big + rank[rest + 2]
        key2 = (t[s2] * size + t[s2 + 1]) * big + rank[s2 + 2]
    else:
        _, pair = np.unique(np.concatenate([t[rest] * size + t[rest + 1], t[s2] * size + t[s2 + 1]]), return_inverse=True)
        rest_key2 = pair[: len(rest)] * big + rank[rest + 2]
        key2 = pair[len(rest) :] * big + rank[s2 + 2]
    # keys are counted in sorted order, which keeps the searches local
    by0, by1, by2 = np.argsort(rest_key), np.argsort(key1), np.argsort(key2)
    sorted_rest, sorted1, sorted2 = rest_key[by0], key1[by1], key2[by2]
    rest_key2 = rest_key2[by0]  # ordered too, as both keys order the same suffixes
    out = np.empty(n, np.int64)
    out[rest[by0]] = np.searchsorted(sorted_rest, sorted_rest) + np.searchsorted(sorted1, sorted_rest) + np.searchsorted(sorted2, rest_key2)
    inside = sample < n
    own = np.bincount(rank[sample])
    base = (np.cumsum(own) - own)[rank[sample]]  # how many ranks are smaller
    more = np.empty(len(sample), np.int64)
    more[by1] = np.searchsorted(sorted_rest, sorted1)
    more[ones + by2] = np.searchsorted(np.sort(rest_key2), sorted2)
    out[sample[inside]] = (base + more)[inside]
    return out


def repeated_windows(contexts: list[bytes], first: np.ndarray, length: int) -> np.ndarray:
    """(context, offset) rows of the windows that repeat an earlier one; first: order of the byte 0 of each context."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.zeros(int(begin[-1]), np.uint8)
    text = np.zeros(len(data), np.int64)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    at = ragged(begin[:-1], sizes)
    data[at] = flat
    text[at] = flat.astype(np.int64) + 2
    text[begin[1:] - 1] = 1
    ranks = difference_cover_order(text, length)
    counts = np.maximum(sizes - length + 1, 0)
    start = ragged(begin[:-1], counts)  # windows that stay in their context
    if not len(start):
        return np.zeros((0, 2), np.int64)
    owner = np.repeat(np.arange(len(contexts)), counts)
    order = np.argsort(ranks[start], kind="stable")
    start, owner = start[order], owner[order]
    # compare adjacent prefixes
    same = np.zeros(len(start), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for a in range(1, len(start), 1 << 15):
        b = min(len(start), a + (1 << 15))
        same[a:b] = (view[start[a - 1 : b - 1]] == view[start[a:b]]).all(1)
    run = np.cumsum(~same)
    position = first[owner] + (start - begin[owner])
    heads = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(position, heads)[run - 1]
    repeats = position > earliest
    return np.stack([owner[repeats], (start - begin[owner])[repeats]], axis=1)


def runs_of(gram: np.ndarray, sizes: np.ndarray, most: int = RUN) -> list[int]:
    """Bounds of runs of whole grams, each ended by the gram with which it has more than ``most`` bytes; sorted grams."""
    ends = np.cumsum(sizes)
    bounds = [0]
    for s in np.flatnonzero(np.diff(gram, prepend=gram[0] - 1))[1:].tolist():
        if ends[s - 1] - (ends[bounds[-1] - 1] if bounds[-1] else 0) > most:
            bounds.append(s)
    return [*bounds, len(gram)]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window starts -> maximal covered runs."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def substring_spans(docs: DataFrame, length: int = 100, most_contexts: int = 20_000) -> DataFrame:
    """(doc_id, tag, text) without copies -> (doc_id, tag, start, end): bytes covered by repeated strings; spans may touch or overlap.

    Documents are ordered by doc_id and tag, which together name a text.
    """

    def find(batches):
        for batch in batches:
            for first, data, offsets in slices(batch.column(2), SLICE):
                text, place, h, lo, hi = anchors(data, offsets, length)
                at = pa.array(first + text)
                span = ((place - lo) * length + hi - lo).astype(np.int32)  # both below length
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((place - offsets[text]).astype(np.int32)), pa.array(span), pa.array(h.view(np.int64))], names=["doc_id", "tag", "place", "span", "gram"])

    found = docs.select("doc_id", "tag", "text").mapInArrow(find, "doc_id long, tag long, place int, span int, gram long")
    grams = durable(found.groupBy("gram").count().where("count > 1").select(F.col("gram").alias("g")), "grams")
    repeated = found.join(grams, F.col("gram") == F.col("g")).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "span", "gram")).alias("at"))
    joined = docs.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "text").join(repeated, (F.col("d") == F.col("doc_id")) & (F.col("t") == F.col("tag"))).select("doc_id", "tag", "text", F.col("at.place").alias("places"), F.col("at.span").alias("spans"), F.col("at.gram").alias("grams"))

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            lists = batch.column("places")
            per = np.diff(np.array(lists.offsets))
            places = np.array(lists.flatten())
            grams = batch.column("grams").flatten()
            owner = np.repeat(np.arange(len(per)), per)
            spans = np.array(batch.column("spans").flatten())
            begin = places - spans // length
            until = begin + spans % length + length
            out = [texts[o][a:b] for o, a, b in zip(owner.tolist(), begin.tolist(), until.tolist(), strict=True)]
            ids = [batch.column(c).take(pa.array(owner)) for c in ("doc_id", "tag")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(begin.astype(np.int32)), grams, pa.array((places - begin).astype(np.int32)), pa.array(out, pa.binary())], names=["doc_id", "tag", "begin", "gram", "lead", "context"])

    contexts = joined.mapInArrow(cut, "doc_id long, tag long, begin int, gram long, lead int, context binary")
    contexts = durable(contexts, "contexts")
    distinct = contexts.groupBy("gram", "lead", "context").agg(F.min(F.struct("doc_id", "tag", "begin")).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = durable(distinct, "distinct")
    # all windows of a context that stands earlier too are repeats; a context of less than a window has none
    copies = contexts.join(distinct.where("n > 1").select(F.col("gram").alias("g"), F.col("lead").alias("l"), F.col("context").alias("c"), "first"), (F.col("gram") == F.col("g")) & (F.col("lead") == F.col("l")) & (F.col("context") == F.col("c")))
    copies = copies.where((F.struct("doc_id", "tag", "begin") > F.col("first")) & (F.length("context") >= length)).select("doc_id", "tag", F.col("begin").alias("start"), (F.col("begin") + F.length("context")).alias("end"))

    # a gram with one context has no other repeats; one with too many contexts for a task is dealt by whole windows
    several = durable(distinct.groupBy("gram").count().where("count > 1").select(F.col("gram").alias("g"), "count"), "several")
    held = distinct.join(several, F.col("gram") == F.col("g"))
    usual = held.where(F.col("count") <= most_contexts)
    offsets = F.sequence(F.lit(0), F.length("context") - length)
    wide = held.where((F.col("count") > most_contexts) & (F.length("context") >= length))
    wide = wide.select("first", "context", F.explode(offsets).alias("o"))
    wide = wide.select(F.substring("context", F.col("o") + 1, F.lit(length)).alias("w"), F.col("first.doc_id").alias("doc_id"), F.col("first.tag").alias("tag"), (F.col("first.begin") + F.col("o")).alias("start"))
    earliest = wide.groupBy("w").agg(F.min(F.struct("doc_id", "tag", "start")).alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("w").alias("w2"), "e")
    again = wide.join(earliest, F.col("w") == F.col("w2")).where(F.struct("doc_id", "tag", "start") > F.col("e")).select("doc_id", "tag", "start", (F.col("start") + length).alias("end"))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = usual.select("gram", "context", F.col("first.doc_id").alias("doc_id"), F.col("first.tag").alias("tag"), F.col("first.begin").alias("begin")).repartition(parts, "gram")

    def sort(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("gram")
        gram = table.column("gram").to_numpy()
        sizes = np.fromiter((len(c) + 1 for c in table.column("context").to_pylist()), np.int64, len(gram))
        bounds = runs_of(gram, sizes)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = table.slice(a, b - a)
            begin = part.column("begin").to_numpy()
            ids = np.stack([part.column(c).to_numpy() for c in ("doc_id", "tag")])
            order = np.lexsort(ids[::-1])
            opens = np.concatenate([[True], (np.diff(ids[:, order]) != 0).any(0)])
            numbers = ids[:, order[opens]].T
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(opens) - 1
            got = repeated_windows(part.column("context").to_pylist(), (rank << 34) + begin, length)
            if not len(got):
                continue
            place = rank[got[:, 0]] << 34 | (begin[got[:, 0]] + got[:, 1])
            lo, hi = _spans(np.unique(place), length)
            own = numbers[lo >> 34]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array((lo & ((1 << 34) - 1)).astype(np.int32)), pa.array((hi & ((1 << 34) - 1)).astype(np.int32))], names=["doc_id", "tag", "start", "end"])

    spans = routed.mapInArrow(sort, "doc_id long, tag long, start int, end int")
    return spans.unionByName(copies).unionByName(again)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, text) -> (doc_id, text, copy, spans) for each row: whether it is a later copy, and what repeats in it otherwise."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    long = F.octet_length("text") >= length
    key = F.sha2(F.encode("text", "UTF-8"), 256)
    # of the rows of one text the smallest doc_id stays
    mine = rows.withColumn("key", F.when(long & F.col("doc_id").isNotNull(), key))
    copies = mine.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = small_side(durable(copies.select(F.col("key").alias("k2"), "keeper"), "copies"))
    marked = mine.join(copies, F.col("key") == F.col("k2"), "left").drop("k2")
    single = marked.where("key is not null and (keeper is null or doc_id = keeper)").select("doc_id", "tag", "text")
    spans = durable(substring_spans(single, length), "spans")
    by_doc = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "d", "tag": "t"})
    out = marked.join(by_doc, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left")
    is_copy = F.col("keeper").isNotNull() & (F.col("doc_id") > F.col("keeper"))
    return out.select("doc_id", "text", is_copy.alias("copy"), F.when(F.col("key").isNotNull() & ~is_copy, F.col("spans")).alias("spans"))


def substring_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row; removed: maximal removed runs of bytes."""

    def cut(batches):
        for batch in batches:
            sizes, gone, hashes, runs = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("copy", "spans"))
            for raw, copy, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), *columns, strict=True):
                merged: list[list[int]] = [[0, len(raw)]] if copy else []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in merged))
                runs.append([{"start": a, "end": b} for a, b in merged])
                hashes.append(digest.hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(hashes, pa.string()), pa.array(runs, kind)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    return without_repeats(docs, length).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")
