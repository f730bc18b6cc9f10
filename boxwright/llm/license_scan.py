"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

DataFrame functions only. Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased; shingles are five words. A template of t distinct shingles belongs to the window size k, the
least power of two (4 at least) with t <= k / 2 + 1. Windows of k shingles start at every k / 2 shingles,
so each run of t shingles lies whole inside one. A window with just the h shingles that ``threshold`` asks of a
template has similarity h / (k + t - h) at least. ``bands_for`` sets the number of one-value bands so that
such a window collides with its template in at least one band with probability ``recall``. A collision is verified: the share of the template's
shingles that the window has must reach ``threshold``.

The band index is kept by the shingle that gives a template its value: a window has that value in a band only if
it holds that shingle and no shingle of a lower hash. So one pass over a text's shingles looks each of them up
among these winners; the MinHash values of the bands are computed for the windows that hold one, as
no other can collide (``indexed=False`` computes them for all windows, with the same result). The
templates (a parameter, some hundreds of shingles) are held in the plan and in one local table whose rows are
templates x bands; Catalyst knows its size and broadcasts it while small.

One shuffle, of a row per document and collision.

Defined results: null and empty texts have no licence; texts of fewer than five words cannot match; each
window is judged by itself, long texts whole; repeated rows of one doc_id and text give one row; an empty
table gives an empty table; other columns aren't carried.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices by which works name their licence. Fixed wording of the licences' own texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_BREAKS = "\t\n\x0b\x0c\r" + "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS, "abcdefghijklmnopqrstuvwxyz" + " " * len(_BREAKS)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), "")


def _shingles(w: Column) -> Column:
    n = F.size(w)
    return F.when(n >= 5, F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5)))).otherwise(F.array().cast("array<long>"))


def bands_for(similarity: float, recall: float = 0.9999) -> int:
    """Bands of one value each, of which one at least collides with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity))) if similarity < 1 else 1


def minhash(shingles: Column, bands: int) -> Column:
    """The MinHash values of a shingle array, each the only value of its band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, i))))


def least_similarity(k: int, t: int, threshold: float) -> float:
    """The similarity of a window of k shingles with a template of t, of which it has just what ``threshold`` asks."""
    h = math.ceil(threshold * t - 1e-9)
    return h / (k + t - h)


def _library(spark: SparkSession, templates: Mapping[str, str], threshold: float, recall: float) -> dict[int, tuple[int, list]]:
    """Window size to (bands, [(name, shingles, MinHash values)]). A row per template on the driver."""
    if not templates:
        return {}
    frame = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("_w"))
    rows = frame.select("name", F.array_distinct(_shingles(F.col("_w"))).alias("sh")).collect()
    sizes: dict[int, list] = {}
    for r in rows:
        if r["sh"]:
            k = 4
            while len(r["sh"]) > k // 2 + 1:
                k *= 2
            sizes.setdefault(k, []).append((r["name"], list(r["sh"])))
    out = {}
    for k, found in sorted(sizes.items()):
        bands = bands_for(min(least_similarity(k, len(s), threshold) for _, s in found), recall)
        made = spark.createDataFrame(found, "name string, sh array<long>").select("name", "sh", minhash(F.col("sh"), bands).alias("m")).collect()
        out[k] = (bands, [(r["name"], list(r["sh"]), list(r["m"])) for r in made])
    return out


def winners(shingles: list[int], values: list[int], hashed: dict[tuple[int, int], int]) -> set[int]:
    """The shingles that give a template its MinHash values."""
    return {x for i, v in enumerate(values) for x in shingles if hashed[x, i] == v}


def _hashed(spark: SparkSession, library: dict[int, tuple[int, list]]) -> dict[tuple[int, int], int]:
    """The hash of each template shingle in each band."""
    bands = max(b for b, _ in library.values())
    known = sorted({x for _, found in library.values() for _, s, _ in found for x in s})
    rows = spark.createDataFrame([(x,) for x in known], "x long").select("x", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64("x", i)).alias("h")).collect()
    return {(r["x"], i): h for r in rows for i, h in enumerate(r["h"])}


def _among(places: str, own: list[int]) -> Column:
    return F.filter(places, lambda i: F.get(F.col("_s"), i).isin(own))


def _windows(k: int, bands: int, won: Column | None) -> Column:
    """The windows of k shingles of ``_s``, with their number of bands; won: places of shingles that a window must hold one of."""
    step, shingles = k // 2, F.col("_s")
    if won is None:
        starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - 1, F.lit(0)), F.lit(step))
    else:
        number = lambda i: F.floor(i / step).cast("int")  # noqa: E731  a shingle lies in the window of its step and in the one before
        starts = F.array_distinct(F.flatten(F.transform(won, lambda i: F.array(number(i) * step, F.greatest(number(i) - 1, F.lit(0)) * step))))
    return F.transform(starts, lambda p: F.struct(F.lit(k).alias("k"), F.lit(bands).alias("b"), F.slice(shingles, p + 1, k).alias("w")))


def license_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, recall: float = 0.9999, indexed: bool = True) -> DataFrame:
    """doc_id, _t (text hash), license, containment: a row per verified collision, and one with nulls for a document without any."""
    spark = docs.sparkSession
    library = _library(spark, templates, threshold, recall)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_t"), words(text).alias("_w")).select("doc_id", "_t", _shingles(F.col("_w")).alias("_s"))
    if not library:
        return rows.select("doc_id", "_t", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("containment"))
    parts = []
    bands_rows = []
    won: dict[int, set[int]] = {}
    hashed = _hashed(spark, library) if indexed else {}
    for k, (bands, found) in library.items():
        bands_rows += [(k, i, v, name, s) for name, s, m in found for i, v in enumerate(m)]
        if indexed:
            won[k] = set().union(*(winners(s, m, hashed) for _, s, m in found))
    if indexed:  # one pass over all shingles; what it leaves is short
        some = sorted(set().union(*won.values()))
        shingles = F.col("_s")
        rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(0), F.greatest(F.size(shingles) - 1, F.lit(0))), lambda i: F.coalesce(F.get(shingles, i).isin(some), F.lit(False))))
    for k, (bands, _) in library.items():
        parts.append(_windows(k, bands, _among("_at", sorted(won[k])) if indexed else None))
    table = spark.createDataFrame(bands_rows, "_k int, _i int, _v long, license string, _sh array<long>")
    each = rows.select("doc_id", "_t", F.explode_outer(F.concat(*parts)).alias("x")).select("doc_id", "_t", F.col("x.k").alias("k"), F.col("x.b").alias("b"), F.col("x.w").alias("w"))
    values = F.transform(F.sequence(F.lit(0), F.coalesce("b", F.lit(1)) - 1), lambda i: F.array_min(F.transform(F.col("w"), lambda x: F.xxhash64(x, i))))
    banded = each.select("doc_id", "_t", "k", "w", F.posexplode_outer(values).alias("i", "v"))
    met = banded.join(table, (F.col("k") == F.col("_k")) & (F.col("i") == F.col("_i")) & (F.col("v") == F.col("_v")), "left")
    share = F.size(F.array_intersect("w", "_sh")) / F.size("_sh")
    return met.select("doc_id", "_t", F.when(share >= threshold, F.col("license")).alias("license"), F.when(share >= threshold, share).alias("containment"))


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, recall: float = 0.9999, indexed: bool = True) -> DataFrame:
    """A row per document: doc_id, n_licenses (long), licenses (names in order, joined by commas), containment (the best, null if none)."""
    found = license_matches(docs, templates, threshold, recall, indexed)
    one = found.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("license")).alias("_l"), F.max("containment").alias("containment"))
    return one.select("doc_id", F.size("_l").cast("long").alias("n_licenses"), F.array_join("_l", ",").alias("licenses"), "containment")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """Every window of every text against every template of its size, without MinHash."""
    q = lambda s: s.replace("'", "''")
    breaks = " || ".join(["'" + q("".join(c for c in _BREAKS if ord(c) > 32)) + "'", *(f"chr({ord(c)})" for c in _BREAKS if ord(c) < 32)])
    cut = f"list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || {breaks}, 'abcdefghijklmnopqrstuvwxyz' || '{' ' * len(_BREAKS)}'), ' '), lambda x: x <> '')"
    shingle = "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))"
    named = ", ".join(f"('{n}', '{q(t)}')" for n, t in sorted(TEMPLATES.items()))
    return f"""
WITH RECURSIVE t0 AS (SELECT name, {cut} AS w FROM (VALUES {named}) v(name, text)),
t1 AS (SELECT name, list_distinct({shingle}) AS sh FROM t0),
t2 AS (SELECT name, sh, greatest(4, 2 ** ceil(log2(greatest(2 * (len(sh) - 1), 1))))::INT AS k FROM t1),
d0 AS (SELECT doc_id, {cut} AS w FROM documents),
d1 AS (SELECT doc_id, {shingle} AS sh FROM d0),
d2 AS (SELECT d1.doc_id, d1.sh, t2.name, t2.k, t2.sh AS tsh FROM d1 JOIN t2 ON len(list_intersect(d1.sh, t2.sh)) >= 0.8 * len(t2.sh)),
d3 AS (SELECT doc_id, name, tsh, sh[p + 1 : p + k] AS win FROM (SELECT *, unnest(range(0, len(sh), k // 2)) AS p FROM d2)),
hits AS (SELECT doc_id, name, max(len(list_intersect(list_distinct(win), tsh))::DOUBLE / len(tsh)) AS c FROM d3 GROUP BY ALL HAVING c >= 0.8),
per AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS l, max(c) AS c FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(l, '') AS licenses, c AS containment FROM documents d LEFT JOIN per USING (doc_id)
"""


OP10_SQL = _sql()
