"""Substring dedup: fixed-block anchors, every rolling window as a probe, hits extended to exact repeats.

A window of ``window`` (35) words holds an aligned block of ``(window + 1) // 2`` (18) words of its text, if
it is odd exactly one. So a window that occurs twice has, at each place, an own block that also occurs elsewhere.

1. Documents are dealt into chunks (``chunk_size``) by a hash of doc_id (the one shuffle of texts; the later
   steps reuse it). A chunk hashes every rolling block-sized window and sends the distinct
   hashes, packed to six bytes each, to hash buckets; its aligned blocks are marked as the index entries.
2. A bucket finds the hashes that two chunks hold and answers each index entry with one bit.
3. Windows whose own block was hit are the extensions of the hit by so many words to the left and to the right. All
   of a hit's extensions are tested at once, by hashes over all their words, which the chunk sends to buckets
   again, so that a passage with many places needs no pairs of places. The chunk gets a bit for each.
4. Words under a window that occurs twice, in the chunk or elsewhere, go: runs of such windows are
   exactly the maximal repeats of at least ``window`` words.

Hashes that a chunk has twice are settled there, and each chunk sends a hash once, so a passage that a
third of all documents share costs one entry per chunk. Chunks and buckets grow in number with the input,
and in size with its square root at most. Windows are equal when 96 bits of two hashes agree; a block's 64 and 48 bits
only choose which windows are tested.

Defined results: null and empty texts have no words and stay empty; kept words are joined by one space;
null doc_ids are dealt by their text; repeated rows count as texts of their own, so both lose what they
share; an empty table gives an empty table; other columns pass through, but one named ``n_words`` or
``n_removed`` is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import scan_bytes
from .text import U64, Words, column, slices, window_starts, windows

CHUNK = 3 << 20


class _Chunk:
    """The words of a chunk of documents, and its rolling and full windows."""

    def __init__(self, texts: pa.Array, window: int):
        h, bounds, self.n = [], [np.zeros(1, np.int64)], 0
        for _, part in slices(texts):
            w = Words(part)
            h.append(w.hashes())
            bounds.append(w.bounds[1:] + self.n)
            self.n += len(w)
        self.h, self.bounds = np.concatenate(h) if h else np.zeros(0, U64), np.concatenate(bounds)
        self.window, self.block = window, (window + 1) // 2
        self.starts = window_starts(self.bounds, window)
        first = np.repeat(self.bounds[:-1], np.maximum(np.diff(self.bounds) - window + 1, 0))
        at = self.starts - first
        self.own = first + -(-at // self.block) * self.block  # where the one aligned block inside starts

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of all rolling blocks, whether each is an unsettled index entry, whether it is settled as repeated here, and the hash number of each full window's own block."""
        rolling = windows(self.h, self.block, 101)
        long = np.flatnonzero(np.diff(self.bounds) >= self.window)
        edges = np.stack([self.bounds[long], self.bounds[long + 1]]).T.reshape(-1)
        part = np.concatenate([[0], edges])
        inner = np.concatenate([np.arange(a, b - self.block + 1) for a, b in part[1:].reshape(-1, 2)]) if len(long) else np.zeros(0, np.int64)
        values, which, counts = np.unique(rolling[inner], return_inverse=True, return_counts=True) if len(inner) else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        number = np.full(self.n + 1, -1)
        number[inner] = which
        own = number[self.own]
        entry = np.zeros(len(values), bool)
        entry[own] = True
        return values, entry & (counts == 1), counts > 1, own

    def full(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose own block was hit: distinct pairs of hashes (n x 2), unsettled, settled as repeated here, number of each."""
        chosen = self.starts[hit]
        if not len(chosen):
            none = np.zeros(0, np.int64)
            return np.zeros((0, 2), U64), none.astype(bool), none.astype(bool), none
        first, second = (windows(self.h, self.window, seed)[chosen] for seed in (202, 303))
        second &= U64(0xFFFFFFFF)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        counts = np.diff(np.append(np.flatnonzero(new), len(new)))
        return np.stack([first[new], second[new]], 1), counts == 1, counts > 1, which


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted hashes (of pairs the first) fall into ascending buckets."""
    first = values if values.ndim == 1 else values[:, 0]
    return ((first >> U64(32)) * U64(buckets)) >> U64(32)


def _parts(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes."""
    b = _bucket(values, buckets)
    if not len(b):
        return []
    at = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]).tolist()
    return [(int(b[i]), i, j) for i, j in zip(at, at[1:])]


SENT = "bucket long, chunk long, hashes binary, asks binary"
ANSWER = "chunk long, stage int, bucket long, bits binary"


def _send(chunk: int, values: np.ndarray, asks: np.ndarray, buckets: int, width: int) -> pa.Table:
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(len(values), 8 * values[:1].size if len(values) else 8)[:, :width]
    parts = _parts(values, buckets)
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
            "chunk": pa.array([chunk] * len(parts), pa.int64()),
            "hashes": pa.array([raw[i:j].tobytes() for _, i, j in parts], pa.binary()),
            "asks": pa.array([np.packbits(asks[i:j]).tobytes() for _, i, j in parts], pa.binary()),
        }
    )


def _answer(stage: int, width: int):
    """Of one bucket: a bit for each hash that a chunk asks about, set where another chunk has it too."""

    def run(table: pa.Table) -> pa.Table:
        parts, asked = [], []
        for raw, asks in zip(table.column("hashes").to_pylist(), table.column("asks").to_pylist()):
            part = np.zeros((len(raw) // width, 8 * -(-width // 8)), np.uint8)
            part[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
            parts.append(part.view("<u8"))
            asked.append(np.unpackbits(np.frombuffer(asks, np.uint8))[: len(part)].astype(bool))
        everything = np.concatenate(parts)
        order = np.lexsort(everything.T[::-1])
        same = (everything[order[1:]] == everything[order[:-1]]).all(1)
        twice = np.zeros(len(order), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        ends = np.cumsum([len(p) for p in parts])
        bits = [np.packbits(twice[end - len(p) : end][a]).tobytes() for p, a, end in zip(parts, asked, ends)]
        keep = [i for i, x in enumerate(bits) if any(x)]
        return pa.table(
            {
                "chunk": table.column("chunk").take(pa.array(keep, pa.int64())),
                "stage": pa.array([stage] * len(keep), pa.int32()),
                "bucket": table.column("bucket").take(pa.array(keep, pa.int64())),
                "bits": pa.array([bits[i] for i in keep], pa.binary()),
            }
        )

    return run


def _found(values: np.ndarray, asks: np.ndarray, known: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """Whether each distinct hash occurs twice: settled in the chunk, or answered."""
    out = known.copy()
    for b, i, j in _parts(values, buckets):
        if b in answers:
            asked = np.flatnonzero(asks[i:j]) + i
            out[asked] = np.unpackbits(np.frombuffer(answers[b], np.uint8))[: len(asked)].astype(bool)
    return out


def _answers(table: pa.Table, stage: int) -> dict[int, bytes]:
    return {b: x for s, b, x in zip(*(table.column(c).to_pylist() for c in ("stage", "bucket", "bits"))) if s == stage}


def chunk_size(total: int) -> int:
    """Bytes of a chunk: CHUNK up to some 30 GB, then with the square root of the input, 190 MB at 100 TB. There are as
    many buckets as chunks, so a chunk's row for a bucket keeps some 50 hashes and its overhead stays small."""
    return max(CHUNK, math.isqrt(350 * total))


def substring_dedup(docs: DataFrame, window: int = 35, chunk_bytes: int | None = None) -> DataFrame:
    """``docs`` with the repeated words of ``text`` gone, and with n_words and n_removed (long)."""
    total = scan_bytes(docs)
    n = min(max(1, -(-total // (chunk_bytes or chunk_size(total)))), 1 << 31)  # buckets are taken from 32 bits
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    deal = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    chunks = docs.select(*names, F.pmod(deal, F.lit(n)).alias("__chunk"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names) + ", n_words long, n_removed long"

    def anchor(key: tuple, table: pa.Table) -> pa.Table:
        values, asks, _, _ = _Chunk(column(table), window).anchors()
        return _send(key[0].as_py(), values, asks, n, 6)

    def extend(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(column(table), window)
        values, asks, known, own = c.anchors()
        hit = _found(values, asks, known, _answers(answers, 1), n)
        values, asks, _, _ = c.full(hit[own])
        return _send(key[0].as_py(), values, asks, n, 12)

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = column(table)
        c = _Chunk(texts, window)
        values, asks, known, own = c.anchors()
        hit = _found(values, asks, known, _answers(answers, 1), n)[own]
        values, asks, known, which = c.full(hit)
        gone = c.starts[hit][_found(values, asks, known, _answers(answers, 2), n)[which]]
        step = np.zeros(c.n + 1, np.int32)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + window, -1)
        removed = np.cumsum(step[:-1]) > 0
        kept, at = [], 0
        for _, part in slices(texts):
            w = Words(part)
            kept += _joined(w, ~removed[at : at + len(w)])
            at += len(w)
        total = np.concatenate([[0], np.cumsum(removed)])[c.bounds]
        out = {f: table.column(f) for f in names} | {"text": pa.array(kept, pa.string())}
        return pa.table(out | {"n_words": pa.array(np.diff(c.bounds), pa.int64()), "n_removed": pa.array(np.diff(total), pa.int64())})

    grouped = chunks.groupBy("__chunk")
    first = grouped.applyInArrow(anchor, SENT).groupBy("bucket").applyInArrow(_answer(1, 6), ANSWER)
    second = grouped.cogroup(first.groupBy("chunk")).applyInArrow(extend, SENT).groupBy("bucket").applyInArrow(_answer(2, 12), ANSWER)
    return grouped.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(cut, schema)


def _joined(w: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    size = len(w.bytes)
    mark = np.zeros(size + 1, np.int32)
    mark[w.starts[keep]] += 1
    mark[w.ends[keep]] -= 1
    take = np.cumsum(mark[:-1]) > 0
    limit = w.offsets[1:][w.owner]
    after = w.ends[keep & (w.ends < limit)]  # the white space right after a kept word
    data = w.bytes.copy()
    take[after], data[after] = True, 32
    ends = np.concatenate([[0], np.cumsum(take)])[w.offsets]
    flat = data[take].tobytes()
    return [flat[a:b].rstrip(b" ").decode() for a, b in zip(ends.tolist(), ends[1:].tolist())]


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: For tables of moderate size: every window is written out.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
hit AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) r USING (k)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 35) t(j)),
each AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
per AS (SELECT e.doc_id, count(g.p) AS n, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS kept FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN per ON w.doc_id = per.doc_id
"""
