"""Quality rules: repetition inside a text by suffix array and longest common prefixes.

The words of each text are sorted into a suffix array by prefix doubling (only groups that still tie
are sorted again), for all texts of a slice at once. The longest common prefix of neighbours in it, found
from the ranks of the doubling rounds, is for each position the longest substring that starts there and
occurs again in the text. Spans of such repeats of at least ``min_words`` words are united: the rule
limits the share of words they cover and the longest of them.

Runs as one ``mapInArrow`` over the scan, without shuffle; memory follows the slice (2 MB of text, or one
longer text).

Defined results: null and empty texts have no words, fail the base rule and aren't kept; repeats may
overlap; a line counts as duplicate when it has a word and equals an earlier line of its text exactly;
repeated rows repeat; an empty table gives an empty table; other columns pass through ``quality_rules``,
and one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, column, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def repeat_lengths(words: Words) -> np.ndarray:
    """For each word, the length in words of the longest substring from it on that occurs twice in its text."""
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    owner = words.owner
    end = words.bounds[1:][owner]
    _, ids = np.unique(words.hashes(), return_inverse=True)
    key = owner * (ids.max() + 1) + ids
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))  # a group's first place in the suffix array
    levels, step = [], 1
    while True:
        levels.append(rank)
        size = np.bincount(rank, minlength=n)
        ties = np.flatnonzero(size[rank] > 1)
        if not len(ties):
            break
        then = ties + step
        second = np.where(then < end[ties], rank[np.minimum(then, n - 1)] + 1, 0)
        ties = ties[np.argsort(rank[ties] * (n + 1) + second)]
        then = ties + step
        second = np.where(then < end[ties], rank[np.minimum(then, n - 1)] + 1, 0)
        group = rank[ties]
        new = np.ones(len(ties), bool)
        new[1:] = group[1:] != group[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(ties)), 0))
        new[1:] |= second[1:] != second[:-1]
        run = np.maximum.accumulate(np.where(new, np.arange(len(ties)), 0))
        rank = rank.copy()
        rank[ties] = group + run - first
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    some = levels[0][a] == levels[0][b]
    a, b = a[some], b[some]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common[same] += 1 << k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, bounds: np.ndarray, min_words: int) -> np.ndarray:
    """Words of each text under the union of its repeats of at least ``min_words`` words."""
    n = len(longest)
    at = np.flatnonzero(longest >= min_words)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + longest[at], -1)
    under = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return under[bounds[1:]] - under[bounds[:-1]]


def _by_text(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measures(texts: pa.Array, min_words: int) -> dict[str, np.ndarray]:
    w = Words(texts)
    n = w.counts
    longest = repeat_lengths(w)
    most = np.zeros(len(n), np.int64)
    if len(w):
        np.maximum.at(most, w.owner, longest)
    dup = []
    for text in texts.to_pylist():
        if "\n" not in text:
            dup.append(0)
            continue
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n,
        "word_chars": _by_text(w.inside & ((w.data & 0xC0) != 0x80), w.offsets),
        "n_symbols": _by_text(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": covered(longest, w.bounds, 5),
        "covered_words": covered(longest, w.bounds, min_words),
        "longest_repeat": most,
    }


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def quality_rules(docs: DataFrame, min_words: int = 3, max_covered: float = 0.5, max_longest: int = 50) -> DataFrame:
    """``docs`` with the measures, base_failed and kept of each whole text.

    base_failed: fewer than 10 words, or more than 20 % of them in repeats of 5 words or more. kept: not
    base_failed, repeats of at least ``min_words`` words cover at most ``max_covered`` of the words, and
    none is longer than ``max_longest`` words.
    """
    fields = [f for f in docs.schema.fields if f.name not in (*LONGS, "base_failed", "kept")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{x} long" for x in LONGS] + ["base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(column(b)):
                m = measures(part, min_words)
                n = m["n_words"]
                failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
                kept = ~failed & (m["covered_words"] <= max_covered * n) & (m["longest_repeat"] <= max_longest)
                own = b.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(m[x].astype(np.int64)) for x in LONGS), pa.array(failed), pa.array(kept)], [*own.schema.names, *LONGS, "base_failed", "kept"])

    return docs.select(*[f.name for f in fields]).mapInArrow(run, schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text", "covered_words", "longest_repeat")


def _covered_sql(k: int) -> str:
    """(doc_id, n): words in windows of k words that the text has twice."""
    windows = f"SELECT doc_id, i, md5(array_to_string(ws[i : i + {k - 1}], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})"
    return f"""(SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM ({windows}) a SEMI JOIN (SELECT doc_id, k FROM ({windows}) GROUP BY ALL HAVING count(*) > 1) r USING (doc_id, k)), range(0, {k}) t(j) GROUP BY doc_id)"""


OP4_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words, coalesce(c3.n, 0) AS covered, c51.n IS NOT NULL AS long_repeat
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN {_covered_sql(5)} c5 USING (doc_id) LEFT JOIN {_covered_sql(3)} c3 USING (doc_id) LEFT JOIN {_covered_sql(51)} c51 USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered <= 0.5 * n_words AND NOT long_repeat AS kept FROM f
"""
