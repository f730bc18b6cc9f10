"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

1. Each text's set of distinct 5-word shingles gets a 128-bit key; texts of equal sets form one node, so
   copies are counted, never paired. A node's MinHash has ``bands x rows`` values, chosen for the target
   recall at the threshold (``choose_bands``).
2. Band hashes are shuffled. A bucket's smallest node is its hub, and a unit is a hub with all nodes of its buckets:
   nodes that share a band are in a unit together, and near copies, whose hubs are mostly the same, in few units.
   Chains of candidates don't make larger units, so texts that only share a page template meet few others.
3. Units are verified on the full sets: up to ``cell`` nodes by one task, larger ones dealt into a triangle of
   cells of two parts each, so no task takes more than ``2 * cell`` nodes. Intersections are counted by matrix
   products over the shingles that at least two nodes have. A pair that is in several units counts in that of its smallest hub.
4. Verified links give each node its number of links and, by components of the links, its class.

Texts move once, to be joined with the nodes to verify, and then to their units. Exact counts of links between n different near
texts take n^2 / 2 comparisons, spread over the cells; pairs are never materialised.

Defined results: words are unchanged; a text of fewer than five words is one shingle of all of them, so
short texts match when equal, and all empty or null texts are copies of one another; a null doc_id is a
document of its own, and isn't used as a class id while the class has another; repeated rows are copies;
an empty table gives an empty table; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .spark_util import groups, partitions, saved
from .text import U64, Shingles, Words, coefficients, column, mix, release, slices


def choose_bands(threshold: float = 0.8, recall: float = 0.9999, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall with at most ``hashes`` values."""
    if threshold >= 1:
        return 1, 1
    best = None
    for rows in range(1, hashes + 1):
        miss = math.log1p(-(threshold**rows))
        bands = math.ceil(math.log(1 - recall) / miss) if miss < 0 else hashes + 1
        if best is None or bands * rows <= hashes:
            best = (bands, rows)
    return best


def band_keys(s: Shingles, bands: int, rows: int) -> np.ndarray:
    """texts x bands: a hash of each band's MinHash values, different for each band."""
    starts = s.bounds[:-1]
    a, c = coefficients(bands * rows, 31), coefficients(bands * rows, 77)
    out = np.zeros((len(starts), bands), U64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(starts), U64(band + 1))
            for i in range(band * rows, (band + 1) * rows):
                key = mix(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat((s.values ^ c[i]) * a[i], starts))
            out[:, band] = key
    return out


def set_keys(s: Shingles) -> np.ndarray:
    """texts x 2: a 128-bit key of each shingle set."""
    starts = s.bounds[:-1]
    size = np.diff(s.bounds).astype(U64)
    with np.errstate(over="ignore"):
        first = mix(np.add.reduceat(mix(s.values + U64(1)), starts) + size)
        second = mix(np.bitwise_xor.reduceat(mix(s.values * U64(0xD6E8FEB86659FD93)), starts) * U64(3) + np.add.reduceat(s.values * s.values, starts))
    return np.stack([first, second], 1)


def signatures(docs: DataFrame, bands: int, rows: int, words: int = 5) -> DataFrame:
    """doc_id, _t (text hash), node (16 bytes), bands (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(column(b)):
                s = Shingles(Words(part), words)
                raw = np.ascontiguousarray(set_keys(s)).view(np.uint8).reshape(len(part), 16)
                node = [x.tobytes() for x in raw]
                keys = band_keys(s, bands, rows).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands), pa.int32()), pa.array(keys))
                own = b.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("_t"), pa.array(node, pa.binary()), lists], ["doc_id", "_t", "node", "bands"])
        release()

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_t")).mapInArrow(run, "doc_id long, _t long, node binary, bands array<long>")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    some = counts[which] > 1
    rows, cols = owner[some], shared[which[some]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    total = np.zeros((m, m), np.float32)
    n = int(cols[-1]) + 1 if len(cols) else 0
    for first in range(0, n, 4096):
        a, b = np.searchsorted(cols, [first, first + 4096])
        part = np.zeros((m, min(4096, n - first)), np.float32)
        part[rows[a:b], cols[a:b] - first] = 1
        total += part @ part.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _verify(threshold: float, words: int):
    """Of one cell: each linked node's number of linked documents and of different texts, without those that an earlier unit counts, and a forest of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cells_of(batches):
            nodes = t.column("node").to_pylist()
            order = sorted(range(len(nodes)), key=nodes.__getitem__)
            t = t.take(pa.array(order))
            nodes = [nodes[i] for i in order]
            sets = []
            for _, part in slices(column(t)):
                s = Shingles(Words(part), words)
                sets += [s.values[a:b] for a, b in zip(s.bounds, s.bounds[1:])]
            size = np.array([len(s) for s in sets], np.float32)
            both = _intersections(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            np.fill_diagonal(linked, False)
            part, i, j = (np.array(t.column(c).to_pylist()) for c in ("part", "i", "j"))
            if i[0] != j[0]:  # two different parts: the pairs inside each are another cell's
                linked &= part[:, None] != part[None, :]
            if not linked.any():
                continue
            hub = t.column("hub")[0].as_py()
            earlier = [[h for h in hubs if h < hub] for hubs in t.column("hubs").to_pylist()]
            place = {h: k for k, h in enumerate(sorted({h for hubs in earlier for h in hubs}))}
            counted = linked
            if place:  # pairs with an earlier unit in common count there
                shared = np.zeros((len(nodes), len(place)), np.float32)
                for k, hubs in enumerate(earlier):
                    shared[k, [place[h] for h in hubs]] = 1
                counted = linked & (shared @ shared.T == 0)
            members = np.array(t.column("members").to_pylist(), np.int64)
            root = np.arange(len(nodes))
            u, v = np.nonzero(linked)
            while True:  # the smallest node reached, by hooking and jumping
                low = root.copy()
                np.minimum.at(low, u, root[v])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some = np.flatnonzero(linked.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[k] for k in some], pa.binary()), pa.array([nodes[r] for r in root[some]], pa.binary()), pa.array((counted.astype(np.int64) @ members)[some], pa.int64()), pa.array(counted.sum(1)[some], pa.int64())],
                ["node", "root", "docs", "texts"],
            )
        release()

    return run


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One cell at a time, also where two share a hash; a node that came twice is there once."""
    for t in groups(batches, "unit"):
        ids = list(zip(*(t.column(c).to_pylist() for c in ("hub", "i", "j", "node"))))
        pick: dict = {}
        for k, x in enumerate(ids):
            pick.setdefault(x[:3], {}).setdefault(x[3], k)
        for cell in pick.values():
            if len(cell) > 1:
                yield t.take(pa.array(list(cell.values())))


def ngram_join(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, cell: int = 512) -> DataFrame:
    """A row per document: doc_id, class_id (smallest doc_id linked with it, over any number of links),
    copy_id (smallest doc_id of the same shingle set), n_links (other documents at the threshold or above,
    copies included) and n_text_links (different shingle sets among them); and _t and _kt, hashes of the text
    and, where the class keeps this set's text, of the text kept."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    signed = saved(signatures(docs, bands, rows, words))
    nodes = saved(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min_by("_t", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("_t"), F.count("*").alias("members"), F.first("bands").alias("bands")))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub <> _last").select("key", "hub")
    units = saved(keyed.join(hubs, "key").select("node", "hub").distinct())  # a hub is in its own unit
    sizes = units.groupBy("hub").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    per_node = units.join(sizes, "hub").groupBy("node").agg(F.collect_list(F.struct("hub", "parts")).alias("_units"))  # as many as bands at most
    wanted = nodes.select("node", "rep", "_t", "members").join(per_node, "node").withColumnsRenamed({"_t": "_nt"})
    text = F.coalesce("text", F.lit(""))
    rows_ = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_t"))
    texts = rows_.join(wanted, (F.col("_t") == F.col("_nt")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "members", "text", F.transform("_units", lambda x: x["hub"]).alias("hubs"), F.inline("_units"))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.withColumns({"i": F.least("part", "_o"), "j": F.greatest("part", "_o")}).withColumn("unit", F.xxhash64("hub", "i", "j"))
    ready = cells.select("unit", "hub", "node", "members", "hubs", "part", "i", "j", "text").repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    checked = saved(ready.mapInArrow(_verify(threshold, words), "node binary, root binary, docs long, texts long"))
    counts = checked.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    roots = components(checked.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("node", "rep", "_t", "members").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    last = F.lit((1 << 63) - 1)
    classes = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.min_by("node", F.coalesce("rep", last)).alias("_keeper"))
    each = named.join(classes, "root").select("node", "class_id", F.col("rep").alias("copy_id"), (F.coalesce("docs", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), F.when(F.col("node") == F.col("_keeper"), F.col("_t")).alias("_kt"))
    return signed.select("doc_id", "_t", "node").join(each, "node").select("doc_id", "class_id", "copy_id", "n_links", "n_text_links", "_t", "_kt")


def ngram_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class left: one of the smallest doc_id (null last), of repeated rows one."""
    found = ngram_join(docs, **options)
    keep = found.where((F.col("_t") == F.col("_kt")) & F.col("doc_id").eqNullSafe(F.col("copy_id"))).select(F.col("doc_id").alias("_kd"), "_kt").distinct()
    marked = docs.withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("_kd")) & (F.col("_t") == F.col("_kt")))
    return kept.dropDuplicates(["doc_id", "_t"]).drop("_kd", "_kt", "_t")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join(docs).drop("_t", "_kt")


#: For tables of moderate size: all pairs with a common shingle are written out.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, p.n = x.n AND p.n = y.n AS same FROM pair p JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * p.n >= 4 * (x.n + y.n - p.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
copy AS (SELECT w.doc_id, least(w.doc_id, coalesce(min(b) FILTER (WHERE same), w.doc_id)) AS copy_id, count(b) AS n_links FROM w LEFT JOIN link ON a = w.doc_id GROUP BY w.doc_id),
other AS (SELECT l.a AS doc_id, count(DISTINCT c.copy_id) AS n FROM link l JOIN copy c ON c.doc_id = l.b WHERE NOT l.same GROUP BY l.a)
SELECT class.doc_id, class_id, copy_id, n_links, coalesce(other.n, 0) AS n_text_links FROM class JOIN copy USING (doc_id) LEFT JOIN other USING (doc_id)
"""
