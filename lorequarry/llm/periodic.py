"""Periodic runs of words: stretches that repeat themselves, such as looped lines of a crawl or of a generated text.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``min_words`` words and
``min_periods`` * q, which no neighbouring word extends.  It needs a minimum of matches w[i] = w[i + q], and so:

1. Lag counting.  For every lag of a document the matches are counted.  A light word adds the differences of all pairs of
   its places; a heavy one, with more pairs than a transform costs, adds its autocorrelation by FFT, rounded to whole numbers
   (exact, as the error stays far below a half).
2. Lags are tried from the smallest up, and only if they have enough matches.  A run found at p also matches at the multiples of p, in an
   island of its own; these matches are taken off, so that a document of one repeated word is scanned once and not at each lag.
3. Island scans.  An island of m matches holds several neighbouring ones of every m/8th place, so these places are looked at first, and
   all places only around them.  The work of all scans stays near n log n.  An island whose stretch is known from a smaller lag has that period.

Spark deals the documents; a task looks at some MB of texts at once.  Words are compared by their bytes.

Defined cases: a null text has no words, no runs and an empty collapsed text; rows are looked at one by one, so a null or repeated
doc_id changes nothing; a text of fewer words than ``min_words`` has no runs; an empty table gives no rows; other columns pass through, but
columns called runs or collapsed are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.llm.textbytes import ragged, slices, words

RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes only."""
    sizes = end - start
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = data[ragged(start, sizes)]
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])
    return column.dictionary_encode().indices.to_numpy()


def least_matches(lag: np.ndarray, min_words: int, min_periods: int) -> np.ndarray:
    """How many matches in a row a run of that period has at least."""
    return np.maximum(min_words, min_periods * lag) - lag


def lag_counts(ids: np.ndarray, cut: np.ndarray, min_periods: int = 4, heavy: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Matches of each lag 0 to n // min_periods of each document, one after the other, and where each document's lags begin."""
    sizes = np.diff(cut)
    most = sizes // min_periods
    base = np.concatenate([[0], np.cumsum(most + 1)])
    total = np.zeros(int(base[-1]), np.int64)
    if not len(ids):
        return total, base
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ids, doc))
    doc, place, word = doc[order], order - cut[doc[order]], ids[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]))
    many = np.diff(np.append(first, len(order)))
    n = sizes[doc[first]]
    dense = many * (many - 1.0) / 2 > heavy * n * np.log2(n + 2)
    # light words: differences of the d-th next place, as long as any is near enough
    group = np.repeat(np.arange(len(first)), many)
    last = (first + many - 1)[group]
    alive = np.flatnonzero(~dense[group])
    d = 1
    while True:
        alive = alive[alive + d <= last[alive]]
        if not len(alive):
            break
        lag = place[alive + d] - place[alive]
        near = lag <= most[doc[alive]]
        alive, lag = alive[near], lag[near]
        np.add.at(total, base[doc[alive]] + lag, 1)
        d += 1
    # heavy words: autocorrelation, those of a document in turn
    for g in np.flatnonzero(dense).tolist():
        o = int(doc[first[g]])
        size = 1 << int(2 * sizes[o] - 1).bit_length()
        x = np.zeros(int(sizes[o]))
        x[place[first[g] : first[g] + many[g]]] = 1.0
        f = np.fft.rfft(x, size)
        matches = np.fft.irfft(f.real * f.real + f.imag * f.imag, size)[: most[o] + 1]
        total[base[o] : base[o + 1]] += np.rint(matches).astype(np.int64)
    total[base[:-1]] = 0
    return total, base


def islands(same: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the stretches of at least ``need`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    start, length = edges[::2], edges[1::2] - edges[::2]
    keep = length >= need
    return start[keep], length[keep]


def lag_islands(w: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, length) of the islands of at least ``need`` matches at one lag."""
    step = max(1, need // 8)
    head, tail = w[: len(w) - lag], w[lag:]
    if step == 1:
        return [(int(a), int(n)) for a, n in zip(*islands(head == tail, need), strict=True)]
    out = []
    for a, n in zip(*islands(head[::step] == tail[::step], need // step), strict=True):
        lo = max(0, (int(a) - 1) * step + 1)  # the sampled places around do not match
        hi = min(len(head), (int(a) + int(n)) * step)
        out += [(lo + int(b), int(m)) for b, m in zip(*islands(head[lo:hi] == tail[lo:hi], need), strict=True)]
    return out


def runs_of(w: np.ndarray, matches: np.ndarray, min_words: int = 6, min_periods: int = 4) -> np.ndarray:
    """(start, length, period) rows of one document, by start and period; matches: those of each lag."""
    left = matches.copy()
    need = least_matches(np.arange(len(left)), min_words, min_periods)
    seen: set[tuple[int, int]] = set()
    out = []
    for lag in np.flatnonzero(left >= np.maximum(need, 1)).tolist():
        if lag == 0 or left[lag] < need[lag]:
            continue
        for start, n in lag_islands(w, lag, int(need[lag])):
            length = n + lag
            if (start, length) in seen:
                continue
            seen.add((start, length))
            out.append((start, length, lag))
            multiples = np.arange(2 * lag, min(length // 2, len(left) - 1) + 1, lag)
            left[multiples] -= length - multiples
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def periodic_runs(docs: DataFrame, min_words: int = 6, min_periods: int = 4) -> DataFrame:
    """docs with runs (start, length and period in words, by start and period) and collapsed: the words joined by blanks,
    without those that a run holds after its first period.

    min_periods is at least 3: a stretch of three periods q has a smaller period only if that divides q.
    """
    if min_periods < 3 or min_words < 2:
        raise ValueError("a run has at least 3 periods and 2 words")
    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    at_text = [f.name for f in kept].index("text")

    def find(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(at_text)):
                start, end, cut = words(data, offsets)
                ids = word_ids(data, start, end)
                total, base = lag_counts(ids, cut, min_periods)
                lag = np.arange(len(total)) - np.repeat(base[:-1], np.diff(base))
                possible = total >= np.maximum(least_matches(lag, min_words, min_periods), 1)
                possible &= lag > 0
                keep = np.ones(len(start) + 1, np.int64)
                found, per = [np.zeros((0, 3), np.int64)], np.zeros(len(cut) - 1, np.int64)
                hits = np.unique(np.searchsorted(base, np.flatnonzero(possible), "right") - 1)
                for o in hits.tolist():
                    runs = runs_of(ids[cut[o] : cut[o + 1]], total[base[o] : base[o + 1]], min_words, min_periods)
                    found.append(runs)
                    per[o] = len(runs)
                    if len(runs):
                        edges = np.zeros(cut[o + 1] - cut[o] + 1, np.int64)
                        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
                        keep[cut[o] : cut[o + 1]] = np.cumsum(edges)[:-1] == 0
                # the kept words, each with the byte behind it as a blank but the last one of a text
                left = np.flatnonzero(keep[:-1])
                owner = np.searchsorted(cut, left, "right") - 1
                final = np.ones(len(left), bool)
                final[:-1] = owner[1:] != owner[:-1]
                sizes = end[left] - start[left]
                ends = np.cumsum(sizes + ~final)
                text = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
                text[ragged(ends - sizes - ~final, sizes)] = data[ragged(start[left], sizes)]
                text_at = np.concatenate([[0], ends])[np.searchsorted(left, cut)].astype(np.int64)
                collapsed = pa.Array.from_buffers(pa.large_string(), len(per), [None, pa.py_buffer(text_at), pa.py_buffer(text)])
                rows = np.concatenate(found)
                items = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), items)
                own = [batch.column(i).slice(row, len(per)) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, lists, collapsed.cast(pa.string())], names=[*batch.schema.names, "runs", "collapsed"])

    schema = T.StructType([*kept, T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(find, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared in whole numbers; of equal ones the first."""
    better = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def replanted(docs: DataFrame) -> DataFrame:
    """docs in which every tenth text, by a checksum of its doc_id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    own = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("__own").cast("long")
    a, p = F.col("__a"), F.col("__p")
    loop = lambda i: F.get(F.col("__own"), F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), loop), " ")
    some = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    marked = docs.withColumn("__own", F.when(some, own)).withColumn("__a", F.when(some, F.pmod(g, n)))
    marked = marked.withColumn("__p", F.when(some, 1 + F.floor((n - F.col("__a")) / (3 + g % 8))))
    return marked.withColumn("text", F.when(some, text).otherwise(F.col("text"))).drop("__own", "__a", "__p")
