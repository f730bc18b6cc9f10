"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaf of symbol i holds ``rank(symbol i, next symbol) * n + i``, or infinity where the pair has no
merge; inner nodes hold the minimum. The root is therefore the leftmost pair of the lowest rank. A merge
updates three leaves, each in O(log n), until the root is infinite, so a pre-token of n symbols takes
O(n log n) however long it is.

The vocabulary file (a parameter) is the JSON of the ``tokenizers`` library: its normaliser and
pre-tokeniser cut a text into pre-tokens, the merges are applied here. Short pre-tokens
are merged many at a time, their trees being the rows of one matrix. Words recur, so each Python worker
keeps the encodings of words and of pre-tokens in two dictionaries of bounded size (``CACHE`` entries,
emptied when full and at the end of a task): a time saving only, results don't depend on it.

Runs as one ``mapInArrow`` over the scan: no shuffle, and nothing is kept between tasks but the cache.

Defined results: null and empty texts encode to no ids and decode to the empty text; special tokens
written in a text become their ids, as the library does by default; very long words are merged whole;
repeated rows repeat; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .text import Words, buffers, column, release, slices

CACHE = 120_000
INF = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def merge(symbols: list[int], pairs: dict[tuple[int, int], int], made: np.ndarray) -> list[int]:
    """Applies the merges to one list of symbol ids, however long. pairs: (left, right) to rank; made: rank to merged id."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    size = 1 << (n - 2).bit_length()
    tree = [INF] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        r = get((sym[i], sym[i + 1]))
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:  # nothing changes further up
                return
            tree[i] = least
            i >>= 1

    def leaf(i: int, k: int) -> int:
        r = get((sym[i], sym[k]))
        return INF if r is None else r * n + i

    while tree[1] < INF:
        rank, i = divmod(tree[1], n)
        j = nxt[i]
        k = nxt[j]
        sym[i], sym[j], nxt[i] = int(made[rank]), -1, k
        if j < n - 1:
            put(j, INF)
        if k < n:
            prv[k] = i
        put(i, leaf(i, k) if k < n else INF)
        if prv[i] >= 0:
            put(prv[i], leaf(prv[i], i))
    return [x for x in sym if x >= 0]


class Merges:
    """The merge table, and the segment trees of many short pre-tokens at a time (one tree per row of a matrix)."""

    WIDE = 64

    def __init__(self, pairs: dict[tuple[int, int], int], made: np.ndarray, n_ids: int):
        self.pairs, self.made, self.base = pairs, made, n_ids + 1
        keys = np.array([a * self.base + b + 1 for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """rank * WIDE + position of each pair, or INF. No symbol is -1."""
        key = left.astype(np.int64) * self.base + right + 1
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (right >= 0) & (left >= 0), self.ranks[i] * self.WIDE + at, INF)

    def many(self, rows: list[list[int]]) -> list[list[int]]:
        """Each row of at most WIDE symbols after all its merges."""
        out: list[list[int]] = [[]] * len(rows)
        flat = np.array([x for r in rows for x in r], np.int32)
        for part, ids, ends in self.merged(flat, np.array([len(r) for r in rows], np.int64)):
            for i, a, b in zip(part, [0, *ends], ends):
                out[i] = ids[a:b]
        return out

    def merged(self, flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """The same of rows given end to end: (row numbers, their ids end to end, where each ends) by and by."""
        starts = np.cumsum(lengths) - lengths
        low = 0
        for size in (1, 2, 4, 8, 16, 32, 64):  # leaves of a tree; a row of n symbols has n - 1 pairs
            chosen = np.flatnonzero((lengths - 1 > low) & (lengths - 1 <= size)) if size > 1 else np.flatnonzero(lengths <= 2)
            low = size
            for first in range(0, len(chosen), 20_000):
                part = chosen[first : first + 20_000]
                yield part.tolist(), *self._trees(flat, starts[part], lengths[part], size)

    def _trees(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[list[int], list[int]]:
        n = size + 1
        rows = range(len(starts))
        at = np.arange(n + 1)
        sym = np.where(at < lengths[:, None], flat[np.minimum(starts[:, None] + at, len(flat) - 1)], -1).astype(np.int32)
        nxt = np.tile(np.minimum(np.arange(1, n + 2), n).astype(np.int32), (len(rows), 1))
        prv = np.tile(np.arange(-1, n, dtype=np.int32), (len(rows), 1))
        tree = np.full((len(rows), 2 * size), INF, np.int64)
        tree[:, size:] = self.leaves(sym[:, :size], sym[:, 1 : size + 1], np.arange(size))
        half = size
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        live = np.arange(len(rows))
        while True:
            live = live[tree[live, 1] < INF]
            if not len(live):
                break
            root = tree[live, 1]
            i = (root % self.WIDE).astype(np.int64)
            j = nxt[live, i]
            k = nxt[live, j]
            new = self.made[root // self.WIDE]
            sym[live, i], sym[live, j], nxt[live, i], prv[live, k] = new, -1, k, i
            h = prv[live, i]
            for at, value in ((j, np.full(len(live), INF)), (i, self.leaves(new, sym[live, k], i)), (h, self.leaves(sym[live, h], new, h))):
                some = (at >= 0) & (at < size)
                row, node = live[some], at[some].astype(np.int64) + size
                tree[row, node] = value[some]
                node >>= 1
                while len(node) and node[0]:  # all are on one level
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node >>= 1
        keep = sym[:, :n] >= 0
        return sym[:, :n][keep].tolist(), np.cumsum(keep.sum(1)).tolist()


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or for those without one the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class _Stretches(Words):
    """Words cut where pre-tokens part for certain, so that fewer different ones remain: marks at the end of a
    word go after an ASCII letter or digit, and words of ASCII without ``<`` are lower-cased."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        if not len(self):
            return
        data = self.bytes
        other = np.concatenate([[0], np.cumsum((data >= 128) | (data == 60))])
        step = np.zeros(len(data) + 1, np.int32)
        as_is = other[self.ends] > other[self.starts]
        step[self.starts[as_is]] += 1
        step[self.ends[as_is]] -= 1
        upper = (data >= 65) & (data <= 90) & (np.cumsum(step[:-1]) == 0)
        self.bytes = np.where(upper, data + 32, data).astype(np.uint8)
        cut = self.ends.copy()
        live = np.arange(len(cut))
        while len(live):
            live = live[(cut[live] > self.starts[live]) & _MARK[data[np.maximum(cut[live] - 1, 0)]]]
            cut[live] -= 1
        both = np.flatnonzero((cut < self.ends) & (cut > self.starts) & _ALNUM[data[np.maximum(cut - 1, 0)]])
        more = np.concatenate([[0], np.cumsum(np.bincount(both, minlength=len(cut)))])
        self.bounds = self.bounds + more[self.bounds]
        starts = np.insert(self.starts, both + 1, cut[both])
        ends = self.ends.copy()
        ends[both] = cut[both]
        self.starts, self.ends = starts, np.insert(ends, both + 1, self.ends[both])


def _spaced(words: Iterable[str]) -> pa.Array:
    """Words by id, each with the space that follows it."""
    return pa.array([w + " " for w in words], pa.large_string())


def _named(names: dict[int, str]) -> pa.Array:
    return _spaced(names.get(i, "") for i in range(max(names) + 1))


def _joined(ids: pa.Array, words: pa.Array) -> Iterator[bytes]:
    """Each list of ids as words with spaces between (null: empty), in UTF-8."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    lengths = np.nan_to_num(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
    data, at = buffers(words.take(ids.flatten()))
    ends = at[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    return (data[a : max(a, b - 1)].tobytes() for a, b in zip(ends, ends[1:]))


class Names:
    """What decoding needs of a vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = _named({i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens") or []})


class Bpe:
    """One vocabulary: whole texts to ids, and ids to text."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        listed = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(listed)}
        made = np.array([self.vocab[a + b] for a, b in listed], np.int32)
        self.merges = Merges(pairs, made, max(self.vocab.values()) + 1)
        self.end = model.get("end_of_word_suffix") or ""
        added = spec.get("added_tokens") or []
        self.added = {x["content"]: x["id"] for x in added}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.texts = [str(i) for i in range(max(self.names) + 1)]
        self.spaced_names, self.spaced_ids = _named(self.names), _spaced(self.texts)
        alphabet = _byte_alphabet()
        self.byte = np.array([self.vocab[c] for c in alphabet], np.int32)
        self.last = np.array([self.vocab[c + self.end] for c in alphabet], np.int32)
        self.library = Tokenizer.from_file(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words: dict[str, tuple[str, int]] = {}
        self.tokens: dict[str, tuple[str, int]] = {}

    def cuts(self, text: str) -> list[str]:
        """Pre-tokens, in the byte alphabet, and special tokens of a stretch without ASCII white space."""
        if text.isascii() and "<|" not in text and text.isprintable():  # normalised by lower case alone; each character is its own byte symbol
            return [text.lower()] if text.isalpha() else self.pieces.findall(text.lower())
        found = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                found.append(part)
            elif part:
                found += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return found

    def symbols(self, piece: str) -> list[int]:
        ids = [self.vocab[c] for c in piece]
        ids[-1] = self.vocab[piece[-1] + self.end]
        return ids

    def _made(self, ids: list[int]) -> tuple[str, int]:
        return " ".join([self.texts[i] for i in ids]), len(ids)

    @staticmethod
    def _plain(text: str) -> bool:
        """Letters whose normal form is their lower case, letter by letter: one pre-token, its bytes the symbols."""
        return text.isalpha() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text)) and len(text) <= Merges.WIDE // 2

    def trim(self, most: int | None = None) -> None:
        """Empties caches that are full (or over ``most``); to be called before missing words are listed."""
        for cache in (self.words, self.tokens):
            if len(cache) >= (CACHE if most is None else most):
                cache.clear()

    def learn(self, words: Iterable[str]) -> dict[str, tuple[str, int]]:
        """The encodings of words that aren't in the cache. Those of ordinary length stay in it."""
        words = list(words)
        plain = [w for w in words if self._plain(w)]
        if plain:
            coded = [w.lower().encode() for w in plain]
            lengths = np.array([len(x) for x in coded], np.int64)
            flat = np.frombuffer(b"".join(coded), np.uint8)
            ends = np.cumsum(lengths) - 1
            symbols = self.byte[flat]
            symbols[ends] = self.last[flat[ends]]
            for part, ids, stops in self.merges.merged(symbols, lengths):
                for i, a, b in zip(part, [0, *stops], stops):
                    self.words[plain[i]] = self._made(ids[a:b])
        cuts = {w: self.cuts(w) for w in words if w not in self.words}
        new = list({p for found in cuts.values() for p in found if p not in self.tokens and p not in self.added})
        short = [p for p in new if len(p) <= Merges.WIDE]
        got = {p: self._made([self.added[p]]) for p in self.added}
        for p, ids in zip(short, self.merges.many([self.symbols(p) for p in short])):
            self.tokens[p] = self._made(ids)
        for p in new:
            if len(p) > Merges.WIDE:
                got[p] = self._made(merge(self.symbols(p), self.merges.pairs, self.merges.made))
        out = {}
        for w, found in cuts.items():
            parts = [self.tokens.get(p) or got[p] for p in found]
            if len(parts) == 1:
                made = parts[0]
            elif parts:
                made = (" ".join([x[0] for x in parts]), sum([x[1] for x in parts]))
            else:
                made = ("", 0)
            (self.words if len(w) <= Merges.WIDE else out)[w] = made
        return out

    def decode(self, ids: pa.Array) -> Iterator[bytes]:
        """The text of each list of ids (null: empty), in UTF-8. The vocabulary has no decoder, so tokens are joined by spaces, special ones included."""
        return _joined(ids, self.spaced_names)

    def digests(self, texts: pa.Array) -> Iterator[tuple[bytes, int, bytes]]:
        """(ids with spaces between, their number, decoded text) of each whole text. Texts of a few MB in all."""
        ids = self.encode(texts)
        return zip(_joined(ids, self.spaced_ids), np.diff(ids.offsets.to_numpy()).tolist(), self.decode(ids))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each whole text. Texts of a few MB in all."""
        words = _Stretches(texts)
        _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        data = words.bytes.tobytes()
        names = [data[i:j].decode() for i, j in zip(words.starts[first].tolist(), words.ends[first].tolist())]
        self.trim()
        rare = self.learn({w for w in names if w not in self.words})
        found = [self.words.get(w) or rare[w] for w in names]
        counts = np.array([x[1] for x in found], np.int64)
        flat = np.array(" ".join([x[0] for x in found if x[1]]).split(), np.int32)
        n = counts[which] if len(which) else counts
        begin = np.repeat((np.cumsum(counts) - counts)[which] - (np.cumsum(n) - n), n) if len(which) else counts
        ids = flat[begin + np.arange(len(begin))]
        ends = np.concatenate([[0], np.cumsum(n)])[words.bounds]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def worker_bpe(path: str) -> Bpe:
    """The vocabulary of this Python worker: loaded once, with its caches, for all its tasks."""
    kept = sys.modules.setdefault("_boxwright_bpe", types.ModuleType("_boxwright_bpe")).__dict__
    if path not in kept:
        kept[path] = Bpe(path)
    kept[path].trim(0)  # what the task before has left
    return kept[path]


def bpe_encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text as an array<int> column, and with ``back`` the text that they decode
    to, in the same pass; input columns of those names are replaced."""
    path = path or default_vocabulary()
    made = [out] if back is None else [out, back]
    fields = [f for f in docs.schema.fields if f.name not in made]
    base = docs.select(*[f.name for f in fields])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{name}` {kind}" for name, kind in zip(made, ("array<int>", "string")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            for first, part in slices(column(b, text), 1 << 20):
                own, ids = b.slice(first, len(part)), bpe.encode(part)
                more = [ids] if back is None else [ids, pa.array([x.decode() for x in bpe.decode(ids)], pa.string())]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*b.schema.names, *made])
        bpe.trim(0)
        release()

    return base.mapInArrow(run, schema)


def bpe_decode(frame: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` with the text that each array of ids decodes to (null array: empty)."""
    path = path or default_vocabulary()
    fields = [f for f in frame.schema.fields if f.name != out]
    base = frame.select(*[f.name for f in fields])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(path).words
        for b in batches:
            for first in range(0, b.num_rows, 256):  # bounds what is decoded at once
                own = b.slice(first, 256)
                texts = pa.array([x.decode() for x in _joined(own.column(ids), names)], pa.string())
                yield pa.RecordBatch.from_arrays([*own.columns, texts], [*b.schema.names, out])
        release()

    return base.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, without the ids leaving the worker."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            n, ids, back = [], [], []
            for _, part in slices(column(b)):
                for x, m, y in bpe.digests(part):
                    n.append(m)
                    ids.append(hashlib.sha256(x).hexdigest())
                    back.append(hashlib.sha256(y).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.trim(0)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
