"""Document fingerprints: SimHash, and all fingerprints within a Hamming radius by covering tables.

A text's terms are its distinct 5-word shingles (a shorter text is one term), weighted by their count.
Each term's hash gives ``BITS`` signed votes; the sign of the weighted sum is the fingerprint's bit. The
votes are counted byte by byte of the hashes: a weighted histogram of the 256 byte values per text and
hash byte, times the signs of the 256 values.

Texts of Jaccard similarity 0.8 over their shingles differ in about 39 of 256 bits, with a deviation of 5.7
(SimHash's angle); ``RADIUS`` adds three deviations. ``near`` and ``near_pairs`` find all fingerprints within
a radius, whatever their number: tables are keyed by some bits of a block of 32, and the keys of ``covering`` are such that any two
fingerprints within the radius share one (Pagh, CoveringLSH: hashing without false negatives). They depend on
the radius alone. ``near_pairs`` cuts a radius under ``bits / 16`` into radius + 1 blocks: two within it agree on a whole block.
The Hamming distance is then checked on all bits. A pair counts in the first table in which it meets, so
pairs need not be written to be counted once. Equal fingerprints are one entry. Fingerprints are dealt into
cells of a triangle by salted row and column, which bounds the rows of any task; up to ``FEW`` in a task are compared one by
one. The number of fingerprints changes cells and tasks, never the pairs. The number of cells grows with its square.

``edited`` pairs each text with the next by ascending doc_id: rows are dealt into ranges of doc_id
(quantiles, one number per range on the driver), sorted within, and each range gets a copy of the first
row after it. Texts are shuffled once.

Defined results: null and empty texts are the empty text, one term of its own; rows with a null doc_id
come first, repeated ids are ordered by their text; the last row's next is the first; a single row's next
is itself; an empty table gives an empty table; extra columns aren't carried.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .spark_util import groups, partitions, saved, scan_bytes
from .text import U64, Shingles, Words, column, mix, release, slices

BITS = 256
#: 39 bits at a similarity of 0.8, and three deviations of 5.7.
RADIUS = 56
RANGES = 1 << 14  # of doc_id at most, as each is a literal of the plan; a range is sorted and streamed, not held
CELL = 1 << 19  # fingerprints of a part on average, 32 bytes each; a task holds two parts
FEW = 2048  # as many in a unit are compared one by one
UNITS = 18  # at least
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)
_MIN = -(1 << 63)


def simhash(texts: pa.Array, bits: int = BITS, words: int = 5) -> np.ndarray:
    """A row of bits / 8 bytes for each text. Texts of a few MB in all."""
    s = Shingles(Words(texts), words)
    n = len(texts)
    votes = np.zeros((n, bits), np.float32)
    size = np.diff(s.bounds)
    few = size[s.owner] <= 24  # of texts with few terms each vote is added by itself; for the others by histogram
    for word in range(bits // 64):
        with np.errstate(over="ignore"):
            h = mix(s.values + U64(0x9E3779B97F4A7C15) * U64(word + 1)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            at = (word * 8 + byte) * 8
            if few.any():
                rows = np.flatnonzero(few)
                own = s.owner[rows]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                votes[own[starts], at : at + 8] = np.add.reduceat(_SIGNS[h[rows, byte]] * s.weights[rows, None].astype(np.float32), starts, axis=0)
            rows = np.flatnonzero(~few)
            if len(rows):
                own = s.owner[rows]
                dense = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
                counts = np.bincount(dense * 256 + h[rows, byte], weights=s.weights[rows], minlength=256 * (dense[-1] + 1)).reshape(-1, 256)
                votes[np.unique(own), at : at + 8] = counts.astype(np.float32) @ _SIGNS
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the share of bits that differ."""
    return 1.0 - np.bitwise_count(a ^ b).sum(1) / (8.0 * a.shape[1])


def fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id and the fingerprint (hexadecimal) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(column(b)):
                marks = [x.tobytes().hex() for x in simhash(part, bits)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(part)), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def covering(radius: int, bits: int = BITS) -> list[tuple[int, int, np.ndarray]]:
    """(block, distance, masks): of any two fingerprints within ``radius``, a block of 32 bits is within its distance,
    and then they agree on one of its masks or more. No blocks where as many masks would be no less than all pairs."""
    blocks = bits // 32
    near = [(block, (radius - block) // blocks) for block in range(blocks)]  # one more in each block would be over the radius in all
    return [(block, t, _masks(t + 1)) for block, t in near if t >= 0] if near[0][1] <= 10 else []


@functools.cache
def _masks(size: int) -> np.ndarray:
    """2 ** size - 1 masks of 32 bits: any ``size - 1`` positions are all left out by one of them or more.

    A position is a vector of ``size`` bits, and a mask has the positions whose vectors have an odd product with its
    own vector: fewer than ``size`` vectors leave a vector to which they are orthogonal. Any vectors do; these are moved
    as long as fewer pairs agree by chance.
    """
    every = np.arange(1, 1 << size, dtype=U64)
    odd = (np.bitwise_count(every[:, None] & every) & 1).astype(np.float32)  # of a mask and a vector
    chosen = (mix(np.arange(32, dtype=U64)) % U64(len(every))).astype(int)
    weight = odd[:, chosen].sum(1)
    for at in [*range(32)] * 8:
        rest = weight - odd[:, chosen[at]]
        chosen[at] = (np.exp2(-rest) @ odd).argmax()  # halves the chance at the masks that have the position
        weight = rest + odd[:, chosen[at]]
    return (odd[:, chosen].astype(np.uint32) << np.arange(32, dtype=np.uint32)).sum(1, dtype=np.uint32)


def _raw(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    """A row of bytes for each fingerprint."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, bits // 8)


def _salt(marks: np.ndarray) -> np.ndarray:
    """A hash of each fingerprint."""
    h = np.zeros(len(marks), U64)
    with np.errstate(over="ignore"):
        for word in np.ascontiguousarray(marks).view(U64).T:
            h = mix(h * U64(0xD6E8FEB86659FD93) + word + U64(1))
    return h


def _units(marks: DataFrame, parts: int, pieces: int, bits: int) -> DataFrame:
    """(unit, marks): the fingerprints of each cell of a triangle of parts, many in one value, for each piece of the tables."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(held: list[np.ndarray]) -> pa.RecordBatch:
            raw = np.concatenate(held)
            part = (_salt(raw) % U64(parts)).astype(int)
            rows: list[tuple] = []
            for p in np.unique(part).tolist():
                value = raw[part == p].tobytes()
                rows += [((min(p, o) * parts + max(p, o)) * pieces + piece, value) for o in range(parts) for piece in range(pieces)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), [pa.int64(), pa.binary()])], ["unit", "marks"])

        held: list[np.ndarray] = []
        for b in batches:
            held.append(_raw(b, bits))
            if sum(map(len, held)) >= 1 << 16:
                yield write(held)
                held = []
        if sum(map(len, held)):
            yield write(held)
        release()

    return marks.mapInArrow(deal, "unit long, marks binary")


def _all_pairs(columns: np.ndarray, radius: int, piece: int, pieces: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A piece's pairs within the radius, some rows at a time."""
    n = columns.shape[1]
    for first in range(piece * 128, n, pieces * 128):
        last = min(first + 128, n)
        far = np.zeros((last - first, n - first), np.uint16)
        for word in columns:
            far += np.bitwise_count(word[first:last, None] ^ word[None, first:])
        one, other = np.nonzero(far <= radius)
        keep = one < other
        yield one[keep] + first, other[keep] + first


def _agreeing(own: np.ndarray, mask: np.uint32, most: int, words: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a block's values that agree on a mask and differ in ``most`` bits at most, and in ``words`` in ``radius`` at most."""
    dealt = np.sort((own & mask).astype(U64) << U64(32) | np.arange(len(own), dtype=U64))
    at = (dealt & U64(0xFFFFFFFF)).astype(np.int64)
    own, words, n = own[at], [w[at] for w in words], len(own)
    lag, first = 0, None
    while first is None or len(first):  # equal keys are neighbours, so only rows with an equal one at this lag can have one at the next
        lag += 1
        if first is None:
            differ = own[lag:] ^ own[:-lag]
            same = (differ & mask) == 0
            near = np.flatnonzero(same & (np.bitwise_count(differ) <= most))
            if np.count_nonzero(same) <= n // 8:  # from here on only these
                first = np.flatnonzero(same)
        else:
            first = first[: np.searchsorted(first, n - lag)]
            differ = own[first] ^ own[first + lag]
            same = (differ & mask) == 0
            first, differ = first[same], differ[same]
            near = first[np.bitwise_count(differ) <= most]
        far = sum((np.bitwise_count(w[near] ^ w[near + lag]) for w in words), np.zeros(len(near), np.uint16))
        near = near[far <= radius]
        yield at[near], at[near + lag]


def _meetings(t: pa.Table, parts: int, pieces: int, radius: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprints, one, other, distance), up to some million pairs at a time: those within the radius that this unit counts."""
    raw = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, bits // 8)
    cell, piece = divmod(t.column("unit")[0].as_py(), pieces)
    across = cell // parts != cell % parts  # two different parts: the pairs inside each are another cell's
    columns = np.ascontiguousarray(raw.view(U64).T)
    cover = covering(radius, bits)
    plain = len(raw) <= FEW or not cover
    if plain:  # all pieces of a cell need one order
        order = np.lexsort(columns)
        raw, columns = raw[order], np.ascontiguousarray(columns[:, order])
    part = _salt(raw) % U64(parts)
    blocks = {} if plain else {block: np.ascontiguousarray(raw.view(np.uint32)[:, block]) for block, _, _ in cover}

    def within(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far = np.zeros(len(one), np.uint16)
        for word in columns:
            far += np.bitwise_count(word[one] ^ word[other])
        keep = far <= radius
        return one[keep], other[keep], far[keep]

    def first_met(one: np.ndarray, other: np.ndarray, block: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that meet in none of the tables before: no earlier block is within its distance, and they agree on no earlier mask."""
        for b, most, masks in cover[: block + 1]:
            if b < block:
                keep = np.bitwise_count(blocks[b][one] ^ blocks[b][other]) > most
                one, other = one[keep], other[keep]
                continue
            differ = blocks[b][one] ^ blocks[b][other]
            for mask in masks[:number]:
                keep = (differ & mask) != 0
                if not keep.all():
                    one, other, differ = one[keep], other[keep], differ[keep]
        return one, other

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if plain:
            yield from _all_pairs(columns, radius, piece, pieces)
            return
        tables = [(block, most, number, mask) for block, most, masks in cover for number, mask in enumerate(masks)]
        for block, most, number, mask in tables[piece::pieces]:
            words = [w for k, w in enumerate(columns) if k != block // 2][: len(columns) // 2]  # the block's own word says less
            for one, other in _together(_agreeing(blocks[block], mask, most, words, radius), 1 << 16):
                one, other, _ = within(one, other)
                yield first_met(one, other, block, number)

    def own() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for one, other in found():
            keep = part[one] != part[other] if across else slice(None)
            yield one[keep], other[keep]

    for one, other in _together(own(), 1 << 20):
        one, other, far = within(one, other)
        yield raw, one, other, far


def _together(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in lists of about ``size``; no empty one."""
    held, n = [], 0
    for pair in pairs:
        if not len(pair[0]):
            continue
        held.append(pair)
        n += len(pair[0])
        if n >= size:
            yield np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
            held, n = [], 0
    if held:
        yield np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])


def _met(marks: DataFrame, bits: int, cell: int) -> tuple[DataFrame, int, int]:
    """The units of the distinct fingerprints, each unit's rows together, the parts and the pieces."""
    own = saved(marks.where("fingerprint IS NOT NULL").select(F.unhex("fingerprint").alias("m")).distinct())
    n = own.count()
    parts = max(1, -(-n // cell))
    pieces = -(-UNITS * 2 // (parts * (parts + 1))) if n > FEW else 1  # few cells are several units each
    units = _units(own, parts, pieces, bits)
    return units.repartition(partitions(marks.sparkSession), "unit").sortWithinPartitions("unit"), parts, pieces


def near(marks: DataFrame, radius: int = RADIUS, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """(fingerprint, n_near, near_class) of the fingerprints with others within ``radius``: their number, and the
    smallest fingerprint linked over any number of links. No pair is written."""
    units, parts, pieces = _met(marks, bits, cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "unit"):
            n, root, raw = None, None, None
            for raw, one, other, _ in _meetings(t, parts, pieces, radius, bits):
                if n is None:
                    n, root = np.zeros(len(raw), np.int64), np.arange(len(raw))
                n += np.bincount(one, minlength=len(raw)) + np.bincount(other, minlength=len(raw))
                u, v = np.concatenate([one, np.arange(len(raw))]), np.concatenate([other, root])  # with the forest so far
                while True:
                    low = root.copy()
                    np.minimum.at(low, u, root[v])
                    np.minimum.at(low, v, root[u])
                    low = low[low]
                    if (low == root).all():
                        break
                    root = low
            if n is not None:
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([raw[k].tobytes() for k in some], pa.binary()), pa.array([raw[k].tobytes() for k in root[some]], pa.binary()), pa.array(n[some])], ["m", "root", "n"])
        release()

    found = saved(units.mapInArrow(run, "m binary, root binary, n long"))
    counts = found.groupBy("m").agg(F.sum("n").alias("n_near"))
    linked = components(found.where("m <> root").select(F.col("m").alias("u"), F.col("root").alias("v")))
    named = counts.join(linked.withColumnRenamed("node", "m"), "m")
    return named.select(F.lower(F.hex("m")).alias("fingerprint"), "n_near", F.lower(F.hex("root")).alias("near_class"))


def near_pairs(marks: DataFrame, radius: int = RADIUS, bits: int = BITS, cell: int | None = None) -> DataFrame:
    """(a, b, distance): the pairs of different fingerprints within ``radius``, a < b as strings.

    marks: a column ``fingerprint``. Under a radius of bits / 16 a block value shared by f fingerprints is dealt into
    ceil(f / cell) salts (1,000 a cell unless said); each row meets each salt of its bucket in one cell of the triangle,
    so no task takes a whole hot bucket and no pair is missed. From there on all fingerprints are dealt so.
    """
    if radius >= bits // 16:
        units, parts, pieces = _met(marks, bits, cell or CELL)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in groups(batches, "unit"):
                for raw, one, other, distance in _meetings(t, parts, pieces, radius, bits):
                    ends = [sorted((raw[i].tobytes().hex(), raw[j].tobytes().hex())) for i, j in zip(one, other)]
                    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends]), pa.array([e[1] for e in ends]), pa.array(distance, pa.int32())], ["a", "b", "distance"])

        return units.mapInArrow(run, "a string, b string, distance int")
    blocks = radius + 1
    cuts = np.linspace(0, bits // 4, blocks + 1).astype(int)  # in hexadecimal digits
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.substring("fingerprint", int(a) + 1, int(b - a)).alias("v")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]))
    keyed = marks.where("fingerprint IS NOT NULL").select("fingerprint").distinct().select("fingerprint", table.alias("t")).select("fingerprint", "t.k", "t.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_s", F.ceil(F.col("_n") / (cell or 1000)).cast("int"))
    dealt = keyed.join(sizes, ["k", "v"]).withColumn("_p", F.pmod(F.xxhash64("fingerprint"), F.col("_s")).cast("int"))
    left = dealt.select("k", "v", F.col("fingerprint").alias("a"), F.col("_p").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_j"))
    right = dealt.select("k", "v", F.col("fingerprint").alias("b"), F.col("_p").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_i"))
    both = left.join(right, ["k", "v", "_i", "_j"]).where("a < b")
    digits = [(i, min(i + 15, bits // 4)) for i in range(0, bits // 4, 15)]

    def part(x: str, a: int, b: int):
        return F.conv(F.substring(x, a + 1, b - a), 16, 10).cast("long")

    distance = sum((F.bit_count(part("a", i, j).bitwiseXOR(part("b", i, j))) for i, j in digits), F.lit(0))
    return both.select("a", "b", distance.cast("int").alias("distance")).where(F.col("distance") <= radius).distinct()


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), bucket and whether a row is a copy: rows of a bucket in order, each followed by its next row."""
    n = min(RANGES, max(partitions(docs.sparkSession), -(-scan_bytes(docs) // (32 << 20))))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_MIN)).alias("_k"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("_k", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:  # the number of cuts below the id: a binary search over literals
        bucket = _search("_k", cuts)
    rows = rows.withColumn("_b", bucket)
    heads = sorted((r["_b"], r["_k"]) for r in rows.groupBy("_b").agg(F.min("_k").alias("_k")).collect())  # a row per bucket
    if not heads:
        return rows.withColumn("_copy", F.lit(False))
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}  # the first head follows the last bucket
    target = F.element_at(F.create_map(*[F.lit(x) for k, b in before.items() for x in (k, b)]), F.col("_k"))
    copies = rows.where(F.col("_k").isin(*before)).withColumn("_b", target)
    last = heads[-1][0]
    parts = rows.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    wrap = F.when(F.col("_copy") & (F.col("_b") == last), 1).otherwise(0)  # after all ids of the last bucket
    return parts.repartition(n, "_b").sortWithinPartitions("_b", wrap, "_k", "text")


def _search(name: str, cuts: list[int]):
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(F.col(name) >= cuts[mid], _search(name, cuts[mid + 1 :]) + (mid + 1)).otherwise(_search(name, cuts[:mid]))


def edited(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Each text and its edited text (the last half replaced by the start of the next text) with both fingerprints.

    Columns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Rows of one bucket in order, in lists of a few MB; each list after the first starts with the last row of the one before."""
        held: list[tuple] = []
        size = 0
        for b in batches:
            for i, text, bucket, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_b", "_copy"))):
                if held and held[-1][2] != bucket:
                    yield held
                    held, size = [], 0
                held.append((i, text, bucket, copy))
                size += len(text)
                if size > 1 << 20 and len(held) > 1:
                    yield held
                    held, size = held[-1:], len(text)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pairs(batches):
            texts = [r[1] for r in rows]
            own = [k for k in range(len(rows) - 1) if not rows[k][3]]
            if not own:
                continue
            half = [len(t) // 2 for t in texts]
            changed = [texts[k][: len(texts[k]) - half[k]] + texts[k + 1][: half[k]] for k in own]
            marks = np.concatenate([simhash(p, bits) for _, p in slices(pa.array(texts, pa.large_string()))])
            others = np.concatenate([simhash(p, bits) for _, p in slices(pa.array(changed, pa.large_string()))])
            a = marks[own]
            out = {
                "doc_id": pa.array([rows[k][0] for k in own], pa.int64()),
                "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()),
                "edited_text": pa.array(changed, pa.string()),
                "fingerprint": pa.array([x.tobytes().hex() for x in a], pa.string()),
                "edited_fingerprint": pa.array([x.tobytes().hex() for x in others], pa.string()),
                "near_edited": pa.array(likeness(a, others), pa.float64()),
                "near_next": pa.array(likeness(a, marks[np.array(own) + 1]), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return followed(docs.select("doc_id", "text")).select("doc_id", "text", "_b", "_copy").mapInArrow(run, schema)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = saved(out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    found = saved(near(rows.select("fingerprint")))
    named = rows.join(found, "fingerprint", "left")
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return named.select(*columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("near_class", "fingerprint").alias("near_class"))
