"""Language-model scoring: a small causal self-attention model trained in numpy on subword ids.

Words (bytes other than white space, A-Z lower-cased) and one end for each document are the tokens.  Counts of all words
and all subword ids of the training documents are summed up by Spark over the whole corpus.  The model reads subword
ids of a public byte-level vocabulary: one layer of causal attention and a dense layer give the distribution over
classes (frequent ids are classes of their own, the others are clustered by what they follow), and the corpus counts give the
distribution inside a class.  The probability of a word is the mean (``share``) of its smoothed corpus frequency and
the model's probability that its subwords come next and then the word is over: only the first subword of a word (and the end)
begins with a space, so the model's mass of such ids tells where words may end, and the words' probabilities sum to 1 at most.  Contexts are windows of WINDOW ids that advance by ADVANCE; each id is scored
once, in the window in which it stands among the last ADVANCE (or in the first window).

The model learns from the whole corpus.  Counts, the classes of ids and the vocabulary come from all training
documents, and the weights from all their windows: each Spark task takes one pass over those of its own documents, and the weights
become the mean over the tasks, by their windows (for the embedding of an id, by how often the task met it).  Only the values
from which that pass begins are fitted on the driver, on ``seed_windows`` windows that a hash chooses.  Counts of the at most
``frequent_words`` most frequent words go to every task; tokens of the other words are joined with their counts in Spark.

Defined cases: null counts as the empty text, which is one end; rows that share a doc_id are scored each; without training
documents all counts are 0 and the model is untrained; a null doc_id counts as training data; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.durable import durable
from lorequarry.llm.neardup import spherical_kmeans
from lorequarry.llm.textbytes import LOWER, mix, prefix_sums, ragged, slices, substring_hash, words

WINDOW, ADVANCE = 32, 24
END_HASH = np.uint64(0x656E642D6F662D64)
WORD_LIMIT = 500_000  # words a worker keeps the subwords of
ROWS = 512  # places for which the output layer is computed at once: their probabilities stay near a core
SLOTS = 20  # bits of a hash that choose a word's slot


class Subwords:
    """Subword ids of words by their hash, kept by a Python worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.opens = np.zeros(self.size, bool)  # ids that begin a word
        self.opens[[i for raw, i in ranks.items() if raw[:1] == b" "]] = True
        self.opens[self.end] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {int(END_HASH): 0}
        self.ids = np.array([self.end], np.int32)
        self.ends = np.array([0, 1])
        self.slot_key, self.slot_at = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)  # the word met last in each slot

    def look_up(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each word) of words with these hashes and places in raw; place -1 is an end."""
        if len(self.number) > WORD_LIMIT:
            self.forget()
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        at = np.where(self.slot_key[slot] == hashes, self.slot_at[slot], -1).astype(np.int64)
        missed = np.flatnonzero(at < 0)
        values, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
        keys, first = values.tolist(), missed[first]
        new = [i for i, k in enumerate(keys) if k not in self.number]
        if new:
            more = [self.encode(" " + raw[start[j] : end[j]].decode()) for j in first[new].tolist()]
            for i in new:
                self.number[keys[i]] = len(self.number)
            lengths = np.fromiter(map(len, more), np.int64, len(more))
            self.ids = np.concatenate([self.ids, np.array([x for m in more for x in m], np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        found = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        at[missed] = found[back]
        own = slot[first]
        self.slot_key[own], self.slot_at[own] = values, -1
        whole = self.slot_key[own] == values  # of words that share a slot one stays
        self.slot_at[own[whole]] = found[whole]
        begin = self.ends[at]
        n = self.ends[at + 1] - begin
        return self.ids[ragged(begin, n)], n


class Places:
    """Places of hashes among sorted keys: the first key that is not smaller, or the last one; buckets by leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(21, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        last = len(self.keys) - 1
        if last < 0:
            return np.zeros(len(h), np.int64)
        at = np.minimum(self.start[h >> self.shift], last).astype(np.int64)
        behind = np.flatnonzero((self.keys[at] < h) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.keys[at[behind]] < h[behind]) & (at[behind] < last)]
        return at


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash, start, end, tokens of each text) of the words of each text and its end (start -1)."""
    data = LOWER[data]
    start, end, cut = words(data, offsets)
    h = substring_hash(prefix_sums(data), start, end)
    n = np.diff(cut)
    at = cut[1:]  # an end after the last word of each text
    return data, np.insert(h, at, END_HASH), np.insert(start, at, -1), np.insert(end, at, -1), n + 1


class Attention:
    """One layer of causal self-attention and one dense layer over subword ids, with classes of ids as output."""

    def __init__(self, size: int, classes: int, dim: int = 16, seed: int = 17):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.w = {
            "token": f(size, dim, scale=0.3),
            "place": f(WINDOW, dim, scale=0.1),
            "qkv": f(dim, 3 * dim, scale=0.25),
            "mix": f(dim, dim, scale=0.25),
            "up": f(dim, 2 * dim, scale=0.25),
            "down": f(2 * dim, dim, scale=0.25),
            "out": f(dim, classes, scale=0.1),
            "bias": np.zeros(classes, np.float32),
        }
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.class_of = np.zeros(size, np.int32)
        self.inside = np.zeros(size)
        self.opening = np.ones(classes, np.float32)  # share of the ids of a class that begin a word

    def forward(self, ids: np.ndarray, tail: int = WINDOW) -> dict[str, np.ndarray]:
        """Windows x WINDOW previous ids -> hidden states of the last ``tail`` places, and what the backward pass needs."""
        w = self.w
        n, d = len(ids), w["mix"].shape[0]
        x = np.take(w["token"], ids, axis=0)
        x += w["place"]
        own = x[:, WINDOW - tail :].reshape(-1, d)
        q = (own @ (w["qkv"][:, :d] * np.float32(1 / np.sqrt(d)))).reshape(n, tail, d)  # scaled
        kv = (x.reshape(-1, d) @ w["qkv"][:, d:]).reshape(n, WINDOW, 2 * d)
        k, v = kv[..., :d], kv[..., d:]
        a = q @ k.transpose(0, 2, 1)
        a += self.mask[WINDOW - tail :]
        if n and a.max() > 60:  # weights stay small; the bound only guards the sum
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a /= (a @ np.ones(WINDOW, np.float32))[..., None]
        c = a @ v
        h = c.reshape(-1, d) @ w["mix"]
        h += own
        u = h @ w["up"]
        np.maximum(u, 0, out=u)
        y = u @ w["down"]
        y += h
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "c": c} | {name: t.reshape(n, tail, -1) for name, t in (("h", h), ("u", u), ("y", y))}

    def log_classes(self, y: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities of the target classes at hidden states y, and of all ids that begin a word."""
        out = np.empty((3, len(y)))  # logarithms in double
        small = self.small(y)
        sums = np.stack([np.ones_like(self.opening), self.opening], axis=1)
        for a in range(0, len(y), ROWS):
            z = y[a : a + ROWS] @ self.w["out"]
            z += self.w["bias"]
            if not small and max(z.max(), -z.min()) > 60:
                np.clip(z, -60, 60, out=z)
            out[0, a : a + ROWS] = z[np.arange(len(z)), target[a : a + ROWS]]
            np.exp(z, out=z)
            out[1:, a : a + ROWS] = (z @ sums).T
        np.log(out[1:], out=out[1:])
        return out[0] - out[1], out[2] - out[1]

    def small(self, y: np.ndarray) -> bool:
        """Whether no output at these hidden states can pass 60, by the lengths of the vectors."""
        longest = lambda t, axis: np.sqrt(np.square(t).sum(axis).max(initial=0))
        return longest(y, 1) * longest(self.w["out"], 0) + np.abs(self.w["bias"]).max() < 60

    def gradients(self, ids: np.ndarray, target: np.ndarray, valid: np.ndarray, tail: int = WINDOW) -> dict:
        """Gradients of the mean loss at the valid places, which are all among the last ``tail``."""
        w = self.w
        s = self.forward(ids, tail)
        d = w["mix"].shape[0]
        flat = lambda t: t.reshape(-1, t.shape[-1])
        rows = np.flatnonzero(valid[:, WINDOW - tail :].reshape(-1))
        whole = len(rows) == len(ids) * tail
        y = flat(s["y"]) if whole else flat(s["y"])[rows]
        own = target[:, WINDOW - tail :].reshape(-1)[rows]
        g = {"out": np.zeros_like(w["out"]), "bias": np.zeros_like(w["bias"])}
        dy, small = np.empty_like(y), self.small(y)
        for a in range(0, len(rows), ROWS):
            part = y[a : a + ROWS]
            z = part @ w["out"]
            z += w["bias"]
            if not small and max(z.max(), -z.min()) > 60:
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z *= (1 / ((z @ np.ones(z.shape[1], np.float32)) * np.float32(len(rows))))[:, None]
            z[np.arange(len(part)), own[a : a + ROWS]] -= np.float32(1 / len(rows))
            g["out"] += part.T @ z
            g["bias"] += np.ones(len(part), np.float32) @ z
            np.matmul(z, w["out"].T, out=dy[a : a + ROWS])
        if not whole:
            dy, some = np.zeros((len(ids) * tail, d), np.float32), dy
            dy[rows] = some
        u = flat(s["u"])
        g["down"] = u.T @ dy
        du = dy @ w["down"].T
        du *= u > 0
        g["up"] = flat(s["h"]).T @ du
        dh = du @ w["up"].T
        dh += dy
        g["mix"] = flat(s["c"]).T @ dh
        dc = (dh @ w["mix"].T).reshape(len(ids), tail, d)
        ds = dc @ s["v"].transpose(0, 2, 1)
        ds -= (dc * s["c"]).sum(-1, keepdims=True)
        ds *= s["a"]
        dq = flat(ds @ s["k"])
        dq *= np.float32(1 / np.sqrt(d))
        dkv = flat(np.concatenate([ds.transpose(0, 2, 1) @ s["q"], s["a"].transpose(0, 2, 1) @ dc], axis=-1))
        x = s["x"]
        g["qkv"] = np.concatenate([flat(x[:, WINDOW - tail :]).T @ dq, flat(x).T @ dkv], axis=1)
        dh += dq @ w["qkv"][:, :d].T
        dx = (dkv @ w["qkv"][:, d:].T).reshape(x.shape)
        dx[:, WINDOW - tail :] += dh.reshape(len(ids), tail, d)
        g["place"] = dx.sum(0)
        met = ids.reshape(-1)
        order = np.argsort(met.astype(np.uint16) if len(w["token"]) <= 1 << 16 else met, kind="stable")
        met = met[order]
        starts = np.flatnonzero(np.diff(met, prepend=-1))
        g["token"] = met[starts], np.add.reduceat(flat(dx)[order], starts)
        return g

    def fit(self, previous: np.ndarray, target: np.ndarray, valid: np.ndarray, steps: int = 600, batch: int = 96, rate: float = 0.01, seed: int = 23) -> None:
        """Adam over shuffled windows."""
        if not len(previous):
            return
        r = np.random.default_rng(seed)
        adam = Adam(self)
        classes = self.class_of[target]
        for t in range(1, steps + 1):
            own = r.integers(0, len(previous), batch)
            adam.step(previous[own], classes[own], valid[own], rate * (1 - t / (steps + 1)) + 1e-5)


class Adam:
    """Steps of a model's weights, in place, with a warm-up of 30 steps."""

    def __init__(self, net: Attention):
        self.net, self.t = net, 0
        self.m = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.w.items()}

    def step(self, previous: np.ndarray, classes: np.ndarray, valid: np.ndarray, rate: float, tail: int = WINDOW) -> None:
        self.t += 1
        rate *= min(1, self.t / 30)
        m, v, w = self.m, self.v, self.net.w
        for k, x in self.net.gradients(previous, classes, valid, tail).items():
            rows, x = x if k == "token" else (slice(None), x)  # only the embeddings met in the batch
            m1, v1 = m[k][rows], v[k][rows]
            m1 += 0.1 * (x - m1)
            v1 += 0.01 * (x * x - v1)
            if k == "token":
                m[k][rows], v[k][rows] = m1, v1
            w[k][rows] -= (rate * (m1 / (1 - 0.9**self.t)) / (np.sqrt(v1 / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def windows(ids: np.ndarray, lengths: np.ndarray, end: int, take=None):
    """Texts of so many ids -> (previous, target, scored, place of each scored id) as windows x WINDOW arrays.

    ``take`` chooses windows by the number of their text and their number in it.
    """
    n = np.where(lengths > WINDOW, 1 + -(-(lengths - WINDOW) // ADVANCE), 1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    if take is not None:
        own = take(owner, nth)
        owner, nth = owner[own], nth[own]
    begin = nth * ADVANCE
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < lengths[owner][:, None]
    place = first[owner][:, None] + np.minimum(at, lengths[owner][:, None] - 1)
    target = ids[place]
    previous = np.where(at == 0, end, ids[np.maximum(place - 1, 0)])
    scored = inside & ((np.arange(WINDOW) >= WINDOW - ADVANCE) | (nth == 0)[:, None])
    return previous, target, scored, place


def log_probabilities(net: Attention, ids: np.ndarray, lengths: np.ndarray, end: int, run: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each id of texts of these lengths, and of any id that begins a word at its place."""
    out, opens = np.zeros(len(ids)), np.zeros(len(ids))
    d = net.w["mix"].shape[0]
    previous, target, scored, place = windows(ids, lengths, end)
    opening = place[:, 0] == np.repeat(np.cumsum(lengths) - lengths, np.where(lengths > WINDOW, 1 + -(-(lengths - WINDOW) // ADVANCE), 1))
    for which, tail in ((np.flatnonzero(opening), WINDOW), (np.flatnonzero(~opening), ADVANCE)):  # others score their last places only
        for a in range(0, len(which), run):
            own = which[a : a + run]
            s = scored[own, WINDOW - tail :]
            y = net.forward(previous[own], tail)["y"].reshape(-1, d)[s.reshape(-1)]
            t = target[own, WINDOW - tail :][s]
            at = place[own, WINDOW - tail :][s]
            hit, opens[at] = net.log_classes(y, net.class_of[t])
            out[at] = hit + net.inside[t]
    return out, opens


def word_probabilities(net: Attention, ids: np.ndarray, each: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Probability of each token (word or end) of so many ids, given those before it; over all words they sum to 1 at most."""
    by_id, opens = log_probabilities(net, ids, lengths, end)
    first = np.cumsum(each) - each
    behind = np.append(opens[first[1:]], 0.0)
    behind[np.isin(first + each, np.cumsum(lengths))] = 0.0  # nothing follows the end of a text
    return np.exp(np.add.reduceat(by_id, first) - opens[first] + behind)


def training(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus != remainder, F.lit(True))


def corpus_counts(docs: DataFrame, path: str) -> DataFrame:
    """(kind, key, n): how often each word (kind 0, by hash) and each subword id (kind 1) stands in docs."""

    def count(batches):
        sub = subwords(path)
        for batch in batches:
            met = [np.zeros(0, np.uint64)]
            by_id = np.zeros(sub.size, np.int64)
            for _, data, offsets in slices(batch.column(0), 1 << 18):
                data, h, start, end, _ = tokens(data, offsets)
                by_id += np.bincount(sub.look_up(h, data.tobytes(), start, end)[0], minlength=sub.size)
                met.append(h)
            values, n = np.unique(np.concatenate(met), return_counts=True)
            seen = np.flatnonzero(by_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([0, 1], np.int32), [len(values), len(seen)])), pa.array(np.concatenate([values.view(np.int64), seen])), pa.array(np.concatenate([n, by_id[seen]]))],
                names=["kind", "key", "n"],
            )

    parts = docs.select("text").mapInArrow(count, "kind int, key long, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def chosen_windows(docs: DataFrame, path: str, share: float) -> DataFrame:
    """(h, ids, scored): about this share of all windows of docs, by hash.

    ids are the id before the window and its own (int32); bits of scored tell which of them are scored.
    Only the documents that a first hash takes are read as ids; in them a second hash takes windows.
    """
    of_docs = min(1.0, 4 * share)
    below = np.uint64(min(int(share / of_docs * 2**64), 2**64 - 1))
    bit = np.int64(1) << np.arange(WINDOW, dtype=np.int64)

    def choose(batches):
        sub = subwords(path)
        for batch in batches:
            salts = batch.column(1).to_numpy().view(np.uint64)
            for first, data, offsets in slices(batch.column(0), 1 << 18):
                data, h, start, end, n = tokens(data, offsets)
                ids, each = sub.look_up(h, data.tobytes(), start, end)
                key = np.zeros(0, np.uint64)

                def take(owner, nth, salt=salts[first : first + len(n)]):
                    nonlocal key
                    key = mix(salt[owner] ^ mix(nth.astype(np.uint64)))
                    own = np.flatnonzero(key <= below)
                    key = key[own]
                    return own

                previous, target, scored, _ = windows(ids, np.add.reduceat(each, np.cumsum(n) - n), sub.end, take)
                rows = np.concatenate([previous[:, :1], target], axis=1).astype(np.int32)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (WINDOW + 1)), len(rows), [None, pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), raw.cast(pa.binary()), pa.array((scored * bit).sum(1))], names=["h", "ids", "scored"])

    salt = F.xxhash64("doc_id", "text")
    taken = docs.select("text", salt.alias("salt")).where(F.pmod(F.xxhash64("salt"), F.lit(1 << 20)) < int(of_docs * (1 << 20)) + 1)
    return taken.mapInArrow(choose, "h long, ids binary, scored long")


def unpacked(batch) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the one before, scored) of a batch or table of (ids, scored)."""
    ids, scored = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column("ids"), batch.column("scored")))
    rows = np.frombuffer(b"".join(ids.to_pylist()), np.int32).reshape(-1, WINDOW + 1)
    return rows, (scored.to_numpy(zero_copy_only=False).astype(np.int64)[:, None] >> np.arange(WINDOW)) & 1 > 0


def new_model(id_counts: np.ndarray, own: np.ndarray, pair: np.ndarray, n: np.ndarray, path: str, heads: int = 96, tails: int = 31) -> Attention:
    """An untrained model: classes of the frequent ids ``own``, and of the others by the frequent ids before them.

    pair is id * heads + class of the id before it, met n times; class sizes and probabilities inside classes come from the corpus counts.
    """
    sub = subwords(path)
    net = Attention(sub.size, heads + tails + 1)
    net.class_of[:] = heads + tails  # ids that no training document holds
    net.class_of[own] = np.arange(len(own))
    tail = np.setdiff1d(np.flatnonzero(id_counts), own)
    if len(tail):
        before = np.zeros((len(tail), heads))
        before[np.searchsorted(tail, pair // heads), pair % heads] = n
        before = np.sqrt(before + 1e-3)
        before /= np.sqrt((before * before).sum(1, keepdims=True))
        net.class_of[tail] = heads + (before @ spherical_kmeans(before, tails).T).argmax(1)
    mass = np.bincount(net.class_of, weights=id_counts + 1.0, minlength=heads + tails + 1)
    net.inside = np.log((id_counts + 1.0) / mass[net.class_of])
    net.opening = np.maximum(np.bincount(net.class_of, weights=np.exp(net.inside) * sub.opens, minlength=heads + tails + 1), 1e-9).astype(np.float32)
    net.w["bias"] = np.log(np.maximum(mass, 1) / mass.sum()).astype(np.float32)
    return net


def pair_counts(docs: DataFrame, path: str, own: np.ndarray, heads: int) -> DataFrame:
    """(pair, n): how often an id that is not frequent follows each frequent one in docs; at most the vocabulary x heads rows."""

    def count(batches):
        sub = subwords(path)
        place = np.full(sub.size, -1, np.int64)
        place[own] = np.arange(len(own))
        for batch in batches:
            met = [np.zeros(0, np.int64)]
            for _, data, offsets in slices(batch.column(0), 1 << 18):
                data, h, start, end, n = tokens(data, offsets)
                ids, each = sub.look_up(h, data.tobytes(), start, end)
                before = np.append(sub.end, ids[:-1])  # every text ends with an end, so each begins after one
                hit = (place[ids] < 0) & (place[before] >= 0)
                met.append(ids[hit] * np.int64(heads) + place[before[hit]])
            pair, n = np.unique(np.concatenate(met), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


CHANGE = "task int, n long, dense binary, ids binary, met binary, token binary"


class Change:
    """Changes of weights, summed with their numbers of windows (of an embedding: how often its id was met)."""

    def __init__(self, net: Attention):
        self.names = [k for k in net.w if k != "token"]
        self.task, self.n = 0, 0
        self.dense = {k: np.zeros(net.w[k].shape) for k in self.names}
        self.met, self.token = np.zeros(len(net.w["token"])), np.zeros(net.w["token"].shape)

    def add(self, batch) -> None:
        for row in batch.to_pylist():
            self.task, self.n = row["task"], self.n + row["n"]
            parts = np.split(np.frombuffer(row["dense"], np.float32), np.cumsum([x.size for x in self.dense.values()])[:-1])
            for x, part in zip(self.dense.values(), parts, strict=True):
                x += part.reshape(x.shape)
            ids = np.frombuffer(row["ids"], np.int32)
            self.met[ids] += np.frombuffer(row["met"], np.float32)
            self.token[ids] += np.frombuffer(row["token"], np.float32).reshape(len(ids), -1)

    def row(self) -> pa.RecordBatch:
        ids = np.flatnonzero(self.met).astype(np.int32)
        f = lambda x: pa.array([x.astype(np.float32).tobytes()], pa.binary())
        dense = np.concatenate([x.reshape(-1) for x in self.dense.values()])
        return pa.RecordBatch.from_arrays([pa.array([self.task], pa.int32()), pa.array([self.n], pa.int64()), f(dense), pa.array([ids.tobytes()], pa.binary()), f(self.met[ids]), f(self.token[ids])], names=["task", "n", "dense", "ids", "met", "token"])

    def apply(self, net: Attention) -> None:
        for k, x in self.dense.items():
            net.w[k] += (x / self.n).astype(np.float32)
        net.w["token"] += (self.token / np.maximum(self.met, 1)[:, None]).astype(np.float32)


def _mean_change(net: Attention, rows: DataFrame, lessons, merging: int = 8) -> None:
    """Every task of ``rows`` goes on from the same weights over what ``lessons`` makes of its batches; net gets the mean of the changes.

    lessons(batch, random numbers) yields (previous, target, scored, tail, rate by the number of steps before).
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def train(batches):
        start = sent.value
        own = copy.copy(start)
        own.w = {k: x.copy() for k, x in start.w.items()}
        adam, out = Adam(own), Change(start)
        r = np.random.default_rng(29)
        out.task = TaskContext.get().partitionId()
        for batch in batches:
            for previous, target, scored, tail, rate in lessons(batch, r):
                adam.step(previous, own.class_of[target], scored, rate(adam.t), tail)
                out.n += len(previous)
                out.met += np.bincount(previous.reshape(-1), minlength=len(out.met))
        if out.n:
            for k in out.names:
                out.dense[k] = (own.w[k] - start.w[k]) * float(out.n)
            out.token = (own.w["token"] - start.w["token"]) * out.met[:, None]
            yield out.row()

    def merge(batches):
        out = Change(sent.value)
        for rows in batches:
            out.add(rows)
        if out.n:
            yield out.row()

    parts = rows.mapInArrow(train, CHANGE).repartition(merging, "task").sortWithinPartitions("task")
    total = Change(net)
    total.add(parts.mapInArrow(merge, CHANGE).toArrow().sort_by("task"))  # a row for each of the ``merging`` partitions
    if total.n:
        total.apply(net)
    sent.unpersist()


def fit_round(net: Attention, chosen: DataFrame, rate: float, batch: int = 96) -> None:
    """A pass over the windows of ``chosen``, in each task its own."""

    def lessons(rows, r):
        ids, scored = unpacked(rows)
        order = r.permutation(len(ids))
        for a in range(0, len(ids), batch):
            now = order[a : a + batch]
            yield ids[now, :-1], ids[now, 1:], scored[now], WINDOW, lambda t: rate

    _mean_change(net, chosen.select("ids", "scored"), lessons)


def fit_texts(net: Attention, docs: DataFrame, path: str, rate: float = 0.003, batch: int = 256) -> None:
    """A pass over all windows of docs, in each task those of its documents; none is stored."""

    def lessons(rows, r):
        sub = subwords(path)
        for _, data, offsets in slices(rows.column(0)):
            data, h, start, end, n = tokens(data, offsets)
            ids, each = sub.look_up(h, data.tobytes(), start, end)
            previous, target, scored, _ = windows(ids, np.add.reduceat(each, np.cumsum(n) - n), sub.end)
            opening = scored[:, 0]  # the first window of a text; the others are scored in their last places only
            for which, tail in ((np.flatnonzero(opening), WINDOW), (np.flatnonzero(~opening), ADVANCE)):
                order = r.permutation(which)
                for a in range(0, len(order), batch):
                    now = order[a : a + batch]
                    yield previous[now], target[now], scored[now], tail, lambda t: rate / np.sqrt(1 + t / 100)

    _mean_change(net, docs.select("text"), lessons)


def fit_model(docs: DataFrame, id_counts: np.ndarray, path: str, seed_windows: int = 24_000, heads: int = 96, tails: int = 31) -> Attention:
    """A model of docs, fitted on all their windows; the driver holds ``seed_windows`` of 140 bytes of them to begin with."""
    own = np.array([i for i in np.argsort(-id_counts, kind="stable")[:heads] if id_counts[i] > 0], np.int64)
    pairs = pair_counts(docs, path, own, heads).toArrow()
    net = new_model(id_counts, own, pairs.column("pair").to_numpy(), pairs.column("n").to_numpy(), path, heads, tails)
    share = min(1.0, 2 * seed_windows / (id_counts.sum() / ADVANCE + 1))
    first = chosen_windows(docs, path, share).orderBy("h", "ids").limit(seed_windows).toArrow()
    ids, scored = unpacked(first)
    net.fit(ids[:, :-1], ids[:, 1:], scored)
    fit_texts(net, docs, path)
    return net


def score_texts(docs: DataFrame, path: str, share: float = 0.5, frequent_words: int = 1_000_000) -> DataFrame:
    """documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each."""
    spark = docs.sparkSession
    seen = docs.where(training(F.col("doc_id")))
    counts = durable(corpus_counts(seen, path), "counts")
    of_words = counts.where("kind = 0")
    total = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count(F.lit(1)).alias("V")).first()
    n_all, floor = total["N"], total["N"] + total["V"] + 1
    # the lowest count with which at most frequent_words words are sent
    least, sent_words = None, 0
    for row in of_words.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if sent_words + row["count"] > frequent_words:
            break
        least, sent_words = row["n"], sent_words + row["count"]
    frequent = of_words.where(F.col("n") >= least).select("key", "n").toArrow() if least is not None else None  # frequent_words at most
    keys = frequent.column("key").to_numpy().view(np.uint64) if frequent is not None else np.zeros(0, np.uint64)
    by_key = np.argsort(keys)
    keys, n_of = keys[by_key], frequent.column("n").to_numpy()[by_key] if frequent is not None else np.zeros(0, np.int64)
    id_counts = np.zeros(subwords(path).size)
    for row in counts.where("kind = 1").toLocalIterator():  # as many as the vocabulary
        id_counts[row["key"]] = row["n"]
    net = fit_model(seen, id_counts, path)
    sent = spark.sparkContext.broadcast((net, Places(keys), n_of))

    def score(batches):
        net, places, n_of = sent.value
        keys = places.keys
        sub = subwords(path)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, data, offsets in slices(batch.column(1), 1 << 18):
                m = len(offsets) - 1
                data, h, start, end, n = tokens(data, offsets)
                ids, each = sub.look_up(h, data.tobytes(), start, end)
                text_of_token = np.repeat(np.arange(m), n)
                lengths = np.add.reduceat(each, np.cumsum(n) - n)
                by_token = word_probabilities(net, ids, each, lengths, sub.end)
                at = places(h)
                have = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                c = n_of[at[have]]
                base = np.log10((c + 1) / floor)
                full = np.log10(share * (c + 1) / floor + (1 - share) * by_token[have])
                owner = text_of_token[have]
                rare = ~have
                sums = [np.bincount(owner, weights=x, minlength=m) for x in (base, full)]
                known = np.bincount(owner, minlength=m)
                tag = substring_hash(prefix_sums(data), offsets[:-1], offsets[1:])
                apart = mix(tag + np.arange(first, first + m, dtype=np.uint64))  # keys that meet nothing: copies of a text are spread too
                own_ids = doc_ids.slice(first, m)
                rare_of = text_of_token[rare]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([own_ids, own_ids, own_ids.take(pa.array(rare_of))]),
                        pa.array(np.concatenate([tag, tag, tag[rare_of]]).view(np.int64) & 0x7FFFFFFF, pa.int32()),
                        pa.array(np.repeat(np.array([1, 2, 0], np.int32), [m, m, len(rare_of)])),
                        pa.array(np.concatenate([apart, ~apart, h[rare]]).view(np.int64)),
                        pa.array(np.concatenate([*sums, by_token[rare]])),
                        pa.array(np.concatenate([n, known, np.zeros(len(rare_of), np.int64)])),
                    ],
                    names=["doc_id", "tag", "kind", "key", "x", "m"],
                )

    # kind 1: base sum of frequent tokens, and all tokens; kind 2: model sum, and known tokens; kind 0: a token of another word
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, tag int, kind int, key long, x double, m long")
    joined = parts.join(of_words.select(F.col("key").alias("k"), F.col("n").alias("c")), F.col("key") == F.col("k"), "left")
    kind = F.col("kind")
    c = F.coalesce("c", F.lit(0))
    p = (c + 1) / F.lit(float(floor))
    sums = joined.groupBy("doc_id", "tag").agg(
        F.sum((kind == 1).cast("long")).alias("copies"),
        F.sum(F.when(kind == 1, F.col("m"))).alias("n_tokens"),
        F.sum(F.when(kind == 2, F.col("m")).when(kind == 0, (c > 0).cast("long"))).alias("n_known"),
        F.sum(F.when(kind == 1, F.col("x")).when(kind == 0, F.log10(p))).alias("base"),
        F.sum(F.when(kind == 2, F.col("x")).when(kind == 0, F.log10(share * p + (1 - share) * F.col("x")))).alias("model"),
    )
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))  # equal rows were summed up
    return each.select(
        "doc_id",
        (~training(F.col("doc_id"))).alias("held_out"),
        *[F.call_function("div", F.col(x), F.col("copies")).alias(x) for x in ("n_tokens", "n_known")],
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("model") / F.col("copies")).alias("score"),
    )
