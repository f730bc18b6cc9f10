"""Mixing sources to target weights: blocks, multinomial draws per shard, index permutations, one join.

1. Pack: the words of a source, its documents in a fixed pseudorandom order, are one long row cut into
   blocks of ``block`` words. Equal rows (source, doc_id and text) are one entry with a number of copies, which lie side by
   side. An entry's place in the row is a prefix sum: totals per (source, bucket of entries) are summed
   first, then places within a bucket, so no window holds a whole source. Texts are read once for their sizes.
2. Targets: sources weigh ``weights`` in turn, by code point, null last, and share ``share`` times all
   words; a target stops at ``cap`` times its source's size and the excess is shared again by weight.
3. Draw: each output shard takes its slots from the sources by a multinomial over what they still owe, so
   that the totals come out exactly. This is a table of shards x sources.
4. Slot i of a source takes block perm(i mod n) of it, perm a keyed Feistel permutation of its n block
   indices (cycle walking): each pass over a source is without replacement, a new pass another order.
5. Slots join blocks by (source, index).

The driver holds a row per source and the table of shards x sources; everything else is distributed. The
draws depend on ``seed`` and on the rows alone, not on files or partitions, so reruns agree.

Defined results: null and empty texts have no words and are never taken; null sources are one source;
sources without words get the target 0; copies of a row share what is taken of them
evenly, the first ones a word more, so each gives at most ``cap`` times its size; an empty table gives an empty table; columns
other than those named aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import saved
from .text import U64, Words, column, mix, release, slices

BLOCK, SHARDS = 128, 64
RUN = 65_536  # slots of one row of the draw table, and of one batch; entries of a bucket
STEP = 4096  # numbers of one array of ``_counted``


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([Words(p).counts for _, p in slices(column(b))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), b.column("_h")], ["doc_id", "source", "size", "_h"])
        release()

    rows = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("_h"))
    return rows.mapInArrow(run, "doc_id long, source string, size long, _h long")


def targets(totals: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words that each source should give. Sources by code point, null last."""
    names = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(totals.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * totals[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = float(cap * totals[s])
            left -= out[s]
            open_.remove(s)
    return out


def draws(slots: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: multinomial counts over what the sources still owe; columns sum to ``slots``."""
    rng = np.random.default_rng(seed)
    owed = np.array(slots, np.int64)
    out = np.zeros((shards, len(owed)), np.int64)
    for k in range(shards):
        want = int(round(owed.sum() / (shards - k)))
        while want > 0 and owed.sum() > 0:
            got = np.minimum(rng.multinomial(want, owed / owed.sum()), owed)
            out[k] += got
            owed = owed - got
            want -= int(got.sum())
    return out


def permute(i: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), elementwise: four Feistel rounds over 4^k >= n values, walked until inside."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(U64)
    low = (U64(1) << bits) - U64(1)
    x, n, seed = i.astype(U64), n.astype(U64), seed.astype(U64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            v, b, m, s = x[todo], bits[todo], low[todo], seed[todo]
            left, right = v >> b, v & m
            for k in range(4):
                left, right = right, left ^ (mix(right + s + U64(k + 1) * U64(0x9E3779B97F4A7C15)) & m)
            x[todo] = (left << b) | right
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


class Mix:
    """A plan: where each document lies in its source's row, what each source gives, and the drawn slots."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shards: int = SHARDS, seed: int = 17):
        self.spark, self.block, self.seed = docs.sparkSession, block, seed
        entries = sizes(docs).groupBy("source", "doc_id", "_h", "size").agg(F.count("*").alias("copies"))
        self.rows = saved(entries.withColumn("words", F.col("size") * F.col("copies")))
        buckets = 64 + self.rows.count() // RUN  # a source's window over them has a row each
        rows = self.rows.withColumn("_c", F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(buckets)))
        part = rows.groupBy("source", "_c").agg(F.sum("words").alias("_n"))
        self.totals = {r["source"]: int(r["n"]) for r in part.groupBy("source").agg(F.sum("_n").alias("n")).collect()}
        self.targets = targets(self.totals, weights, share, cap)
        self.names = [s for s in self.targets if self.totals[s] > 0]
        blocks = [-(-self.totals[s] // block) for s in self.names]
        slots = [min(int(round(self.targets[s] * n / self.totals[s])), int(cap * n)) for s, n in zip(self.names, blocks)]
        self.table = draws(slots, shards, seed) if self.names else np.zeros((0, 0), np.int64)
        self.blocks = blocks
        before = part.select("source", "_c", (F.sum("_n").over(_window("source", "_c")) - F.col("_n")).alias("_before"))
        inside = F.sum("words").over(_window(["source", "_c"], ["_h", "doc_id", "size"], rows=True)) - F.col("words")
        same = (F.col("l.source").eqNullSafe(F.col("r.source"))) & (F.col("l._c") == F.col("r._c"))
        placed = rows.withColumn("_in", inside).alias("l").join(before.alias("r"), same)
        self.placed = placed.select("l.doc_id", "l.source", "l._h", "l.size", "l.words", (F.col("_before") + F.col("_in")).alias("start"))

    def segments(self) -> DataFrame:
        """doc_id, source, _h, size, block, from_word, n_words: the part of each entry that lies in a block, counted over all its copies in a row."""
        b = self.block
        rows = _counted(self.placed.where("size > 0"), f"start div {b}", f"(start + words - 1) div {b}", "block")
        first = F.greatest(F.col("start"), F.col("block") * b)
        last = F.least(F.col("start") + F.col("words"), (F.col("block") + 1) * b)
        return rows.select("doc_id", "source", "_h", "size", "block", (first - F.col("start")).alias("from_word"), (last - first).alias("n_words"))

    def slots(self) -> DataFrame:
        """shard, slot, source, block, epoch: a row for each drawn block."""
        rows, at = [], [0] * len(self.names)
        for k, counts in enumerate(self.table.tolist()):
            slot = 0
            for j, c in enumerate(counts):
                if c:
                    rows.append((k, self.names[j], self.blocks[j], j, at[j], c, slot))
                    at[j], slot = at[j] + c, slot + c
        step = max(RUN, sum(r[5] for r in rows) // 500_000)  # so that the table keeps to some 500,000 rows more at any size
        runs = [(shard, source, n, j, first + r, min(step, c - r), slot + r) for shard, source, n, j, first, c, slot in rows for r in range(0, c, step)]
        table = self.spark.createDataFrame(runs, "shard int, source string, n long, j long, first long, count long, slot long")
        seed = self.seed

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    for at in range(0, r["count"], RUN):
                        i = np.arange(r["first"] + at, r["first"] + min(r["count"], at + RUN))
                        n = np.full(len(i), r["n"])
                        epoch = i // n
                        with np.errstate(over="ignore"):
                            key = mix((U64(r["j"]) << U64(32)) + epoch.astype(U64) + U64(seed) * U64(0xD6E8FEB86659FD93))
                        slot = r["slot"] + at + np.arange(len(i))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["shard"], np.int32)), pa.array(slot), pa.array([r["source"]] * len(i), pa.string()), pa.array(permute(i % n, n, key)), pa.array(epoch)], ["shard", "slot", "source", "block", "epoch"])

        spread = max(1, min(len(runs), sum(r[5] for r in rows) // 200_000))
        return table.repartition(spread).mapInArrow(place, "shard int, slot long, source string, block long, epoch long")

    def drawn(self) -> DataFrame:
        """shard, slot, epoch and the segment of every document part in a drawn block."""
        same = F.col("s.source").eqNullSafe(F.col("d.source")) & (F.col("s.block") == F.col("d.block"))
        return self.slots().alias("s").hint("merge").join(self.segments().alias("d"), same).select("shard", "slot", "epoch", "d.*")


def _counted(rows: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """A row for each number of a range, in steps, so that no row holds a long array."""
    steps = rows.withColumn("_s", F.explode(F.expr(f"sequence({first}, {last}, {STEP}L)")))
    return steps.withColumn(name, F.explode(F.expr(f"sequence(_s, least(_s + {STEP - 1}, {last}))"))).drop("_s")


def _window(keys, order, rows: bool = False):
    from pyspark.sql import Window

    keys, order = [keys] if isinstance(keys, str) else keys, [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents' rows after mixing: a row for each pass over the sources in which parts of a document
    were drawn, with ``text`` the drawn words of that pass in order, joined by one space. Other columns of
    the document are kept, n_chars (if any) follows the text; what no slot drew is left out. Copies of a
    row (source, doc_id and text) give one row a pass, with the words drawn of all of them."""
    plan = Mix(docs, **options)
    spans = plan.drawn().groupBy("doc_id", "_h", "source", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("_spans"))
    names = list(docs.columns)
    key = F.xxhash64("doc_id", "text")
    rows = docs.withColumn("_h", key).alias("t").hint("merge").join(spans.withColumnsRenamed({"doc_id": "_d", "source": "_o", "size": "_z"}).alias("s"), (F.col("t._h") == F.col("s._h")) & F.col("t.doc_id").eqNullSafe(F.col("s._d")) & F.col("t.source").eqNullSafe(F.col("s._o")))
    wanted = [f for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passes = None, set()
        for b in batches:
            texts, chars, first_of = [], [], []
            for *own, epoch in zip(*(b.column(c).to_pylist() for c in ("__h", "__d", "__o", "__e"))):
                if own != key:  # the merge join brings the rows of a document together
                    key, passes = own, set()
                first_of.append(epoch not in passes)
                passes.add(epoch)
            b = b.filter(pa.array(first_of, pa.bool_()))
            spans = b.column("__s").to_pylist()
            for first, part in slices(column(b)):
                w = Words(part)
                data = w.bytes.tobytes()
                for i in range(len(part)):
                    at, out = int(w.bounds[i]), []
                    size = int(w.bounds[i + 1]) - at
                    for s in spans[first + i]:
                        a, left = s["from_word"] % size, s["n_words"]
                        while left > 0:  # from one copy on to the next
                            z = min(size, a + left)
                            out += [data[p:q] for p, q in zip(w.starts[at + a : at + z].tolist(), w.ends[at + a : at + z].tolist())]
                            a, left = 0, left - (z - a)
                    texts.append(b" ".join(out).decode())
                    chars.append(len(texts[-1]))
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(chars, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n].cast(b.schema.field(n).type) if n in new else b.column(n) for n in names], names)
        release()

    return rows.select(*[f"t.{n}" for n in names], F.col("s._h").alias("__h"), F.col("s._d").alias("__d"), F.col("s._o").alias("__o"), F.col("s.epoch").alias("__e"), F.col("s._spans").alias("__s")).mapInArrow(run, schema)


def taken(plan: Mix) -> DataFrame:
    """doc_id, source, size, taken: a row for each input row, with the words that the mix takes of it, repeats counted."""
    drawn = plan.drawn().groupBy("doc_id", "_h", "source").agg(F.sum("n_words").alias("_taken")).withColumnsRenamed({"doc_id": "_d", "_h": "_g", "source": "_o"})
    same = (F.col("d._h") == F.col("_g")) & F.col("d.doc_id").eqNullSafe(F.col("_d")) & F.col("d.source").eqNullSafe(F.col("_o"))
    each = plan.rows.alias("d").hint("merge").join(drawn, same, "left").select("doc_id", "source", "size", "copies", F.coalesce("_taken", F.lit(0)).alias("_taken"))
    rows = _counted(each, "0L", "copies - 1", "_i")
    share = F.expr("_taken div copies") + F.when(F.col("_i") < F.col("_taken") % F.col("copies"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", share.cast("long").alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    plan = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    known = [(s, n, plan.targets[s]) for s, n in plan.totals.items()]
    per = spark.createDataFrame(known, "_s string, source_size long, target double") if known else spark.createDataFrame([], "_s string, source_size long, target double")
    joined = taken(plan).alias("d").join(per, F.col("d.source").eqNullSafe(F.col("_s")))  # a row per source, of known size: Catalyst sends it to all tasks if it is small
    return joined.select("d.doc_id", "d.size", "source_size", "target", "taken")
