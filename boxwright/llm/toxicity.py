"""Toxicity: a linear classifier of word and word-start features, regularised by counterfactual swaps.

Features are present-or-absent hashes (``2 ** LOG_FEATURES`` of them) of each word (a run of ASCII letters,
digits and non-ASCII characters, A-Z lower-cased) and of its first 4 to 8 bytes, so that inflected and
made-up forms of a stem count together. Training picks the features whose presence goes with the label (a
smoothed log-odds lower bound), then fits a logistic model on them by gradient descent. For every labelled
sentence that names a group, the identity term is swapped for others of its set, and the squared change
of the score is penalised, so mentions of groups don't move the score.

The classifier is fitted on a bounded sample: of the labelled rows at most ``max_positive`` toxic and
``max_negative`` other texts, the first by a hash of doc_id. Only their distinct hashes reach the driver
(a few kilobytes a text). The weights are sent to the executors (``4 * 2 ** LOG_FEATURES`` bytes, 4 MB).
Scoring is one ``mapInArrow`` over the scan, without shuffle, over whole texts.

Defined results: null and empty texts get the score of no features; label rows with null id or label are
skipped, of repeated ids the largest label counts; with no labels at all every score is the prior 0.5;
repeated rows repeat; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import U64, Words, column, mix, release, slices

LOG_FEATURES = 20
#: Sets of identity terms; a term is swapped for the others of its set. A parameter: pass your own.
IDENTITY = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen"),
    ("woman", "man", "girl", "boy", "mujer", "hombre", "femme", "homme", "frau"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
)
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word as six columns, text of each word, word hashes)."""
    w = Words(texts, _BREAK, lower=True)
    whole = w.hashes()
    shift = U64(64 - LOG_FEATURES)
    with np.errstate(over="ignore"):
        columns = [whole >> shift] + [mix(w.hashes(limit=k) + U64(k)) >> shift for k in (4, 5, 6, 7, 8)]
    return np.stack(columns, 1).astype(np.int32), w.owner, whole


def _term_features(term: str) -> np.ndarray:
    return word_features(pa.array([term], pa.large_string()))[0][0]


def _term_hash(term: str) -> int:
    return int(word_features(pa.array([term], pa.large_string()))[2][0])


def _sample(docs: DataFrame, labels: DataFrame, positive: int, negative: int) -> pa.Table:
    """(toxic, distinct features, identity hashes) of the bounded sample."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64(F.lit(5), "doc_id")
    chosen = one.where("toxic = 1").orderBy(key, "doc_id").limit(positive).unionByName(one.where("toxic <> 1").orderBy(key, "doc_id").limit(negative))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    known = np.array(sorted({_term_hash(t) for s in IDENTITY for t in s}), dtype=U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, named = [], []
            for _, part in slices(column(b)):
                f, owner, whole = word_features(part)
                at = np.searchsorted(owner, np.arange(len(part) + 1))
                for i in range(len(part)):
                    found.append(np.unique(f[at[i] : at[i + 1]]).astype("<i4").tobytes())
                    named.append(np.intersect1d(whole[at[i] : at[i + 1]], known).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(found, pa.binary()), pa.array(named, pa.binary())], ["toxic", "features", "named"])

    return rows.mapInArrow(run, "toxic int, features binary, named binary").toArrow()  # at most positive + negative rows


class Model:
    """Weights per feature (most are zero) and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        f, owner, _ = word_features(texts)
        value = self.weights[f]
        rows, cols = np.nonzero(value)
        pair = np.unique(owner[rows].astype(np.int64) << LOG_FEATURES | f[rows, cols])
        total = np.bincount(pair >> LOG_FEATURES, weights=self.weights[pair & ((1 << LOG_FEATURES) - 1)], minlength=len(texts)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_negative: int = 8000, penalty: float = 1e-4, swap_penalty: float = 1.0, steps: int = 300, keep: int = 2048) -> Model:
    """A model from the labelled rows of ``docs``; labels: doc_id, toxic."""
    rows = _sample(docs, labels, max_positive, max_negative)
    size = 1 << LOG_FEATURES
    if not rows.num_rows:
        return Model(np.zeros(size, np.float32), 0.0)
    y = rows.column("toxic").to_numpy().astype(float)
    sets = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("features")]  # views, not copies
    names = [np.frombuffer(x.as_buffer(), "<u8").tolist() for x in rows.column("named")]
    del rows
    pos, neg = np.zeros(size), np.zeros(size)
    for s, t in zip(sets, y):
        (pos if t else neg)[s] += 1
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    if not n_pos or not n_neg:
        return Model(np.zeros(size, np.float32), 4.0 if n_pos else -4.0)
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    low = np.where(pos + neg >= 5, np.abs(odds) - 3 * error, -1)
    chosen = np.flatnonzero(low > 1.0)
    chosen = chosen[np.argsort(-low[chosen], kind="stable")][:keep]
    number = np.full(size, -1)
    number[chosen] = np.arange(len(chosen))
    own = [number[s][number[s] >= 0] for s in sets]
    row, col = np.repeat(np.arange(len(own)), [len(s) for s in own]), np.concatenate([*own, np.zeros(0, int)]).astype(int)
    terms = {_term_hash(t): (k, t) for k, s in enumerate(IDENTITY) for t in s}
    d_row, d_col, d_val, n_swaps = [], [], [], 0
    for named, s in zip(names, own):
        have = set(s.tolist())
        for h in named:
            k, term = terms[h]
            before = {x for x in number[_term_features(term)].tolist() if x >= 0}
            for other in IDENTITY[k]:
                if other != term:
                    after = {x for x in number[_term_features(other)].tolist() if x >= 0}
                    for x, v in [(x, -1.0) for x in before - after] + [(x, 1.0) for x in after - before - have]:
                        d_row.append(n_swaps)
                        d_col.append(x)
                        d_val.append(v)
                    n_swaps += 1
    d_row, d_col, d_val = np.array(d_row, int), np.array(d_col, int), np.array(d_val)
    w, bias = np.zeros(len(chosen)), float(np.log(n_pos / n_neg))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):  # Adam on the full sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=len(y)) + bias, -40, 40)))
        g = (p - y) / len(y)
        grad = np.bincount(col, weights=g[row], minlength=len(w)) + penalty * w
        if len(d_row):
            change = np.bincount(d_row, weights=w[d_col] * d_val, minlength=n_swaps)
            grad += swap_penalty * np.bincount(d_col, weights=change[d_row] * d_val, minlength=len(w)) / n_swaps
        full = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(size, np.float32)
    weights[chosen] = w
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; an input column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 4 MB, whatever the input
    fields = [f for f in docs.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            s = np.concatenate([m.scores(p) for _, p in slices(column(b, text))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out])
        release()

    return docs.select(*[f.name for f in fields]).mapInArrow(run, schema)


def toxicity_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, by a model fitted on its labelled rows."""
    model = fit(docs, labels, **options)
    scored = score(docs, model, out="__score")
    return scored.where(F.col("__score") < threshold).drop("__score")


def held_out(doc_id) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
