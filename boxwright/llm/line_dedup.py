"""Line dedup: explode normalised lines, hash them, find the documents of each hash, drop, reassemble.

DataFrame functions only. A key is a line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased. A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold
loses all its lines, but for those of the smallest doc_id holding it.

Shuffles: one small row per line (two 64-bit hashes, id, position), partially aggregated per key before
it moves, so a line that a third of all documents share reaches the reducer as one row per task; and
each text once, to be put together again. Nothing is broadcast by hint.

Defined results: null and empty texts are one empty line; a null doc_id orders after all others and all
null ids count as one document; rows that repeat a doc_id are one document for the counts, and each
row is cleaned by itself; an empty table gives an empty table; other columns pass through, and one
named like an output (``n_lines``, ``n_dropped``) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import saved

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each long enough line: document, text hash, position, 128-bit key hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("_d"), F.xxhash64(text).alias("_t"), F.split(text, "\n").alias("_a"))
    lines = rows.select("_d", "_t", F.posexplode("_a").alias("_p", "_line")).where(F.length("_line") >= min_chars)
    keys = lines.select("_d", "_t", "_p", line_key(F.col("_line")).alias("_k")).where(F.length("_k") >= min_chars)
    return keys.select("_d", "_t", "_p", F.xxhash64("_k").alias("_h"), F.xxhash64(F.lit(11), "_k").alias("_g"))


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(_h, _g, _first) of each key that at least ``min_docs`` documents hold."""
    lines = _lines(docs, min_chars)
    if min_docs == 2:  # two documents: the smallest and the largest id differ
        found = lines.groupBy("_h", "_g").agg(F.min("_d").alias("_first"), F.max("_d").alias("_n"))
        return found.where("_first < _n").select("_h", "_g", "_first")
    one = lines.groupBy("_h", "_g", "_d").agg(F.lit(1).alias("_one"))
    found = one.groupBy("_h", "_g").agg(F.min("_d").alias("_first"), F.count("*").alias("_n"))
    return found.where(F.col("_n") >= min_docs).select("_h", "_g", "_first")


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the repeated lines of ``text`` gone, and with n_lines and n_dropped (long)."""
    repeated = saved(repeated_lines(docs, min_chars, min_docs))  # read back, the join below is of two plain shuffles, whose hot keys are split
    dropped = (
        _lines(docs, min_chars)
        .join(repeated, ["_h", "_g"])
        .where("_d <> _first")
        .groupBy("_d", "_t")
        .agg(F.collect_set("_p").alias("_gone"))  # at most the lines of one text
        .withColumnsRenamed({"_d": "_gd", "_t": "_gt"})
    )
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*others, text.alias("text"), F.coalesce("doc_id", F.lit(_LAST)).alias("_d"), F.xxhash64(text).alias("_t"))
    joined = rows.join(dropped, (F.col("_d") == F.col("_gd")) & (F.col("_t") == F.col("_gt")), "left")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    kept = joined.withColumns({"_parts": parts, "_left": left}).select(
        *others,
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_left", lambda i: F.get(F.col("_parts"), i)), "\n")).alias("text"),
        F.size("_parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n"),
    )
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return kept.select(*order, "n_lines", F.greatest("_n", F.lit(0)).alias("n_dropped"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP8_SQL = f"""
WITH lines AS (
  SELECT d.doc_id, u.i AS pos, string_split(coalesce(d.text, ''), chr(10))[u.i] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS i) u
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WS}), '{UPPER}', '{LOWER}') AS k FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT a.doc_id, a.pos, a.line, (r.k IS NOT NULL AND a.doc_id <> r.first_doc) AS gone FROM keyed a LEFT JOIN repeated r ON a.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
