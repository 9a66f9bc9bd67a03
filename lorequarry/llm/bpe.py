"""BPE encoding and decoding with a pair occurrence index.

Each partition keeps the codes of the words it has met.  The new words of a batch are encoded together: their symbols
stand in one array, each pair of neighbours is mapped to all its positions, and the ranks that occur are applied in
ascending order; applying one updates the lists of the pairs that begin and end at the merged places.  A merge only
makes pairs that come later in the merge table, as a rule; where a lower rank appears beside it, the pass goes back to
that rank first.

The tokenizer file is read once for each Python worker from a path that is a parameter.  Only its tables are used:
normalisation (NFC, white space, lower case), the split pattern, byte symbols, vocabulary and merges.

Defined cases: null is the empty text; empty texts have no ids; special tokens in a text are those of the file and
give their single id; repeated rows are encoded each; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np

from lorequarry.llm.textbytes import ragged

WORD_LIMIT = 100_000  # words kept by a partition before it forgets them: memory, not results, depends on it
LEARN = 8192  # words encoded together: every place in them takes some hundred bytes meanwhile


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The tables of one tokenizer file, and the codes of the words met so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.merges: dict[int, tuple[int, int]] = {}
        n = max(self.vocab.values()) + 1
        self.n = n
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = self.vocab[a] * n + self.vocab[b]
            self.rank.setdefault(key, r)
            self.merges.setdefault(r, (key, self.vocab[a + b]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in symbols])
        self.last = np.array([self.vocab[c + self.suffix] for c in symbols])
        self.sorted_keys = np.array(sorted(self.rank))
        self.sorted_ranks = np.array([self.rank[int(k)] for k in self.sorted_keys])
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.raw_of = {i: i.to_bytes(4, "little") for i in self.text_of}
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, bytes] = {}  # ids of the pieces of the split pattern
        self.index = Numbers()  # words between white space, by number in the pools
        self.ids, self.text = Pool(np.uint32), Pool(np.uint8)

    def split(self, text: str) -> list[str]:
        """The normalised text cut at white space; no piece of the split pattern crosses it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # lower case by character: a final sigma is not special here
            text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # space for str.split alone
            return [w for w in self.space.split(text) if w]
        return text.split()

    def words(self, text: str) -> list[str]:
        """The words of a text, in order; a special token stands as its own word, after a mark that no word has."""
        if self.by_special is None or "<|" not in text:
            return self.split(text)
        out: list[str] = []
        for part in self.by_special.split(text):
            out += [" " + part] if part in self.special else self.split(part)
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes pieces not met before, all together."""
        if not words:
            return
        raws = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        code = self.apply_ranks(ids, ends)
        raw_of = self.raw_of
        a = 0
        for w, b in zip(words, ends.tolist(), strict=True):
            own = [i for i in code[a:b] if i >= 0]
            a = b
            self.codes[w] = b"".join([raw_of[i] for i in own])

    def apply_ranks(self, start: np.ndarray, ends: np.ndarray) -> list[int]:
        """Applies all merges inside the words that end at ``ends``; swallowed places become -1."""
        n, rank, merges = self.n, self.rank.get, self.merges
        size = len(start)
        after = np.arange(1, size + 1)
        after[ends - 1] = size
        before = np.arange(-1, size - 1)
        before[ends[:-1]] = -1
        inside = np.flatnonzero(after < size)
        key = start[inside] * n + start[inside + 1]
        slot = np.minimum(np.searchsorted(self.sorted_keys, key), len(self.sorted_keys) - 1)
        known = self.sorted_keys[slot] == key
        inside, of = inside[known], self.sorted_ranks[slot[known]]
        order = np.argsort(of, kind="stable")
        inside, of = inside[order], of[order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        places: list[list[int] | None] = [None] * (len(merges) + 1)  # rank of a pair -> positions of its left half
        for r, at in zip(of[np.concatenate([[0], cuts])].tolist() if len(of) else [], np.split(inside, cuts), strict=False):
            places[r] = at.tolist()
        ids, after, before = start.tolist(), after.tolist(), before.tolist()
        r, last = 0, len(merges)
        while r < last:
            at = places[r]
            if at is None:
                r += 1
                continue
            places[r] = None
            pair, made = merges[r]
            base = made * n
            at.sort()
            lowest = r
            for i in at:
                j = after[i]
                if j >= size or ids[i] * n + ids[j] != pair or ids[i] < 0:
                    continue  # the pair is no longer there
                ids[i] = made
                ids[j] = -1
                k = after[i] = after[j]
                if k < size:
                    before[k] = i
                    q = rank(base + ids[k])
                    if q is not None:
                        if places[q] is None:
                            places[q] = [i]
                            if q < lowest:
                                lowest = q
                        else:
                            places[q].append(i)
                h = before[i]
                if h >= 0:
                    q = rank(ids[h] * n + made)
                    if q is not None:
                        if places[q] is None:
                            places[q] = [h]
                            if q < lowest:
                                lowest = q
                        else:
                            places[q].append(h)
            r = lowest
        return ids

    def meet(self) -> None:
        """Appends ids and decoded bytes of the words met since the last call to the tables."""
        words, self.index.new = self.index.new, []
        for a in range(0, len(words), LEARN):
            self._meet(words[a : a + LEARN])

    def _meet(self, words: list[str]) -> None:
        findall = self.pattern.findall
        cut = [([w] if w.isascii() and w.isalpha() else findall(w)) if w[0] != " " else [] for w in words]
        self.learn(list({p for ps in cut for p in ps if p not in self.codes}))
        codes, text_of = self.codes, self.text_of
        ids, text = [], []
        for w, ps in zip(words, cut, strict=True):
            if len(ps) == 1:
                i = codes[ps[0]]
            elif w[0] == " ":
                i = self.raw_of[self.special[w[1:]]]
            else:
                i = b"".join([codes[p] for p in ps])
            ids.append(i)
            text.append("".join([text_of[x] + " " for x in memoryview(i).cast("I")]).encode())
        self.ids.append(ids, 4)
        self.text.append(text, 1)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text."""
        if len(self.index) > WORD_LIMIT or len(self.codes) > WORD_LIMIT:
            self.forget()
        number = self.index.__getitem__
        cut = [self.words(t) for t in texts]
        each = np.fromiter((number(w) for ws in cut for w in ws), np.int64)
        if self.index.new:
            self.meet()
        ends = np.cumsum([len(ws) for ws in cut])
        out = []
        for kind, width in ((self.ids, 4), (self.text, 1)):
            got, lengths = kind.take(each)
            to = np.concatenate([[0], np.cumsum(lengths)])[ends] * width
            flat = got.tobytes()
            out.append([flat[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)])
        return [(i, t[:-1]) for i, t in zip(*out, strict=True)]


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Pool:
    """Byte strings by number, in one buffer, to be taken many at a time."""

    def __init__(self, dtype):
        self.dtype, self.data = dtype, np.zeros(1 << 16, dtype)
        self.ends = np.zeros(1, np.int64)

    def append(self, values: list[bytes], width: int) -> None:
        more = np.frombuffer(b"".join(values), self.dtype)
        used = int(self.ends[-1])
        if used + len(more) > len(self.data):
            self.data = np.concatenate([self.data[:used], np.zeros(max(used, len(more)) + 1024, self.dtype)])
        self.data[used : used + len(more)] = more
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // width
        self.ends = np.concatenate([self.ends, used + np.cumsum(lengths)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.ends[numbers]
        lengths = self.ends[numbers + 1] - start
        return self.data[ragged(start, lengths)], lengths


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One instance for each Python worker and file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _groups(texts, most: int = 1 << 19):
    """Runs of whole texts of about so many characters, from an Arrow column; only a run at a time is held as text."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def bpe_codes(docs, path: str, columns: list[str], digests: bool = False):
    """The named columns of docs with ids (array<int>) and decoded (the text the ids decode to).

    With ``digests`` n_tokens, ids_sha256 and decoded_sha256 stand in their place.
    """
    import pyarrow as pa

    kinds = dict(docs.dtypes)
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [extra])
    source = docs.select(*columns, docs["text"].alias("__text"))

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(batch.num_columns - 1)):
                rows = bpe.encode(group)
                kept = [batch.column(i).slice(at, len(group)) for i in range(len(columns))]
                at += len(group)
                n = [len(r[0]) // 4 for r in rows]
                if digests:
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in zip(*rows, strict=True)]
                else:
                    cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(r[0] for r in rows), "<i4")
                    more = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), pa.array([r[1] for r in rows]).cast(pa.string())]
                names = [*columns, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), *more], names=names)

    return source.mapInArrow(run, schema)
