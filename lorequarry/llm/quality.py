"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of SPAN steps of 4 bytes run over the whole document in overlapping chunks (one every
4 bytes), the largest answer of each filter anywhere in the document is kept, and a small dense layer combines these
maxima into one probability.  The network is fitted on a bounded sample of labelled documents (``max_rows``, drawn by a hash of the
doc_id, whole texts); scoring sees every byte of every document and nothing but the text.

Defined cases: null counts as the empty text; an empty text has the score of a document without any byte; labels that
are null or belong to no document are left out; with no labelled row, or labels of one kind only, every score is the
share of good labels (0.5 without labels); rows that share a doc_id are scored each, and train once for each row (at
most 2 * max_rows rows); a null doc_id counts as held out; an empty table gives no rows; columns other than doc_id and text pass through, but
those called held_out, score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.textbytes import ragged, slices

STEP = 4  # bytes between chunks
SPAN = 4  # steps that a filter sees


def padded_chunks(data: np.ndarray, offsets: np.ndarray):
    """Texts laid out so that each fills whole steps and ends with zero bytes: (bytes n x STEP, first step of each text)."""
    sizes = np.diff(offsets)
    steps = sizes // STEP + SPAN
    first = np.concatenate([[0], np.cumsum(steps)])
    out = np.zeros(int(first[-1]) * STEP, np.uint8)
    out[ragged(first[:-1] * STEP, sizes)] = data
    return out.reshape(-1, STEP), first


class ByteNet:
    """Weights and the forward and backward passes."""

    def __init__(self, embed: int = 6, filters: int = 48, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (256, embed)).astype(np.float32),
            "filters": r.normal(0, 0.2, (SPAN, STEP * embed, filters)).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "dense": r.normal(0, 0.3, (filters, hidden)).astype(np.float32),
            "dense_bias": np.zeros(hidden, np.float32),
            "out": r.normal(0, 0.3, hidden).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def answers(self, chunks: np.ndarray) -> np.ndarray:
        """Answer of each filter at each chunk that has all its steps."""
        x = self.w["embed"][chunks].reshape(len(chunks), -1)
        n = len(x) - SPAN + 1
        a = x[:n] @ self.w["filters"][0]
        for i in range(1, SPAN):
            a += x[i : n + i] @ self.w["filters"][i]
        return a

    def pooled(self, chunks: np.ndarray, first: np.ndarray, most: int = 1 << 15) -> np.ndarray:
        """Largest answer of each filter in each text, in runs of texts that fit the cache; no chunk looks into the next text."""
        out = np.empty((len(first) - 1, self.w["bias"].shape[0]), np.float32)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(first, first[i] + most, "right")) - 1)
            j = min(j, len(out))
            lo, hi = int(first[i]), int(first[j])
            if j == i + 1 and hi - lo > most:  # a very long text, piece by piece
                best = np.full(out.shape[1], -np.inf, np.float32)
                for a in range(lo, hi - SPAN + 1, most):
                    best = np.maximum(best, self.answers(chunks[a : min(a + most + SPAN - 1, hi)]).max(0))
                out[i] = best
            else:
                a = self.answers(chunks[lo:hi])
                ends = first[i + 1 : j + 1] - lo
                for back in range(1, SPAN):
                    at = ends - back
                    a[at[at < len(a)]] = -np.inf
                out[i:j] = np.maximum.reduceat(a, first[i:j] - lo)
            i = j
        return out + self.w["bias"]

    def probability(self, chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        p = np.maximum(self.pooled(chunks, first), 0)
        h = np.maximum(p @ self.w["dense"] + self.w["dense_bias"], 0)
        z = (h @ self.w["out"] + self.w["out_bias"]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradients of the log loss; only the chunk with the largest answer of a filter passes it on."""
        w = self.w
        a = self.answers(chunks)
        best = np.stack([lo + a[lo : hi - SPAN + 1].argmax(0) for lo, hi in zip(first[:-1], first[1:], strict=True)])
        p = np.take_along_axis(a, best, 0) + w["bias"]
        on = np.maximum(p, 0)
        hid = on @ w["dense"] + w["dense_bias"]
        h = np.maximum(hid, 0)
        z = h @ w["out"] + w["out_bias"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        dh = np.outer(dz, w["out"]) * (hid > 0)
        dp = (dh @ w["dense"].T) * (p > 0)
        g = {"out": h.T @ dz, "out_bias": dz.sum(keepdims=True), "dense": on.T @ dh, "dense_bias": dh.sum(0), "bias": dp.sum(0)}
        g["embed"], g["filters"] = np.zeros_like(w["embed"]), np.empty_like(w["filters"])
        e = w["embed"].shape[1]
        for i in range(SPAN):
            seen = chunks[best + i]  # texts x filters x STEP
            g["filters"][i] = np.einsum("tf,tfk->kf", dp, w["embed"][seen].reshape(*best.shape, -1))
            back = (dp[:, :, None] * w["filters"][i].T[None]).reshape(-1, e)
            at = seen.reshape(-1)
            for c in range(e):
                g["embed"][:, c] += np.bincount(at, weights=back[:, c], minlength=256)
        return g

    def fit(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.004, seed: int = 11) -> ByteNet:
        """Adam over shuffled batches of whole texts."""
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        t = 0
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                own = order[i : i + batch]
                sizes = first[own + 1] - first[own]
                part = chunks[ragged(first[own], sizes)]
                g = self.gradients(part, np.concatenate([[0], np.cumsum(sizes)]), y[own])
                t += 1
                lr = rate * (1 - t / total) + 1e-5
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v2[k] += 0.01 * (x * x - v2[k])
                    self.w[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-7)
        return self


def held_out(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, **how) -> ByteNet:
    """A network fitted on at most ``max_rows`` labelled documents outside the held-out fold."""
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    wanted = wanted.groupBy("doc_id").agg(F.min(label).alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # at most max_rows rows
    table = rows.orderBy("doc_id").limit(2 * max_rows).toArrow()
    texts = table.column("text").combine_chunks()
    parts = [padded_chunks(d, o) for _, d, o in slices(texts)] if len(texts) else []
    y = np.array(table.column("__y").to_pylist(), np.float32)
    if not parts:
        return ByteNet().fit(np.zeros((0, STEP), np.uint8), np.zeros(1, np.int64), y)
    firsts, base = [np.zeros(1, np.int64)], 0
    for c, f in parts:
        firsts.append(f[1:] + base)
        base += len(c)
    return ByteNet().fit(np.concatenate([c for c, _ in parts]), np.concatenate(firsts), y, **how)


def score_quality(docs: DataFrame, net: ByteNet, threshold: float = 0.3) -> DataFrame:
    """docs (without text, and without columns called held_out, score or predicted) with held_out, score and predicted."""
    carried = [c for c in docs.columns if c not in ("text", "held_out", "score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights
    kinds = dict(docs.dtypes)

    def score(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, data, offsets in slices(batch.column(batch.num_columns - 1)):
                chunks, first = padded_chunks(data, offsets)
                out[at : at + len(first) - 1] = sent.value.probability(chunks, first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*carried, "score"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carried] + ["score double"])
    scored = docs.select(*[F.col(f"`{c}`") for c in carried], "text").mapInArrow(score, schema)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The documents that the classifier does not reject, all columns."""
    net = fit_quality(docs, labels, **how)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns

    def keep(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, data, offsets in slices(batch.column(names.index("text"))):
                chunks, first = padded_chunks(data, offsets)
                out[at : at + len(first) - 1] = sent.value.probability(chunks, first)
            yield batch.filter(pa.array(out >= threshold))

    return docs.mapInArrow(keep, docs.schema)
