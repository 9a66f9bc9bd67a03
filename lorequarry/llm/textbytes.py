"""Vectorised looks at many texts at once, as bytes: words, lines and their 64-bit hashes.

An Arrow string column already is one byte buffer with offsets.  ``slices`` cuts a batch into runs of whole texts of a
few MB, so that the 8-byte temporaries stay small; only a single text longer than that makes a longer run.
Hashes are polynomial with random byte values modulo 2**64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
MARKS = np.zeros(256, bool)  # all ASCII bytes but a-z and 0-9
MARKS[:128] = True
MARKS[[*range(48, 58), *range(97, 123)]] = False
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, step, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring can be taken (see ``substring_hash``)."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUE[data] * _power("up", len(data)), out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _power("down", len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def slices(column, target: int = 1 << 20):
    """Arrow string column -> (first row, data, offsets) for runs of whole texts; null counts as empty.

    offsets[i] to offsets[i + 1] are the bytes of text first + i in data.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:  # else the texts are not copied
        column = column.fill_null("")
    _, at, raw = column.buffers()
    n = len(column)
    at = np.frombuffer(at, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + target, "right")) - 1)
        j = min(j, n)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE):
    """Runs of bytes other than white space (or what else is ``blank``) inside each text: (start, end, first word of each text, one past the last)."""
    solid = ~blank[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    cut = np.searchsorted(start, offsets)
    return start, end, cut


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] values, all in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each text its distinct k-word shingles as sorted 64-bit hashes, A-Z lower-cased.

    A text of fewer than k words has all its words as one shingle; a text without words has none.
    """
    data = LOWER[data]
    start, end, cut = words(data, offsets)
    h = substring_hash(prefix_sums(data), start, end)
    with np.errstate(over="ignore"):
        weights = mix(np.arange(1, k + 1, dtype=np.uint64), 99) | np.uint64(1)
        if len(h) >= k:
            rolled = h[: len(h) - k + 1] * weights[0]
            for j in range(1, k):
                rolled = rolled + h[j : len(h) - k + 1 + j] * weights[j]
            rolled = mix(rolled)
        else:
            rolled = np.zeros(0, np.uint64)
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * weights[: b - a]).sum()], np.uint64), b - a))
            else:
                out.append(h[:0])
    return out
