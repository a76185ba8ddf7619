"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are folded to distinct ones first, so copies cost nothing later.
Candidates meet in buckets: a table of the index names some bit positions, and
fingerprints that agree on them share a bucket.  Inside a bucket the distances
of many rows are counted at once: the block's fingerprints are stored as bit
planes, mismatch planes are added three at a time into vertical counters by
carry-save adders, and a block is given up once every pair exceeds the radius.

Two searches are on offer.  By radius alone, ``exact_tables`` takes all ways to
agree on ``blocks - radius`` of ``blocks`` bit blocks, so no pair within the
radius is missed.  By similarity, texts meet in buckets of single shingles: of
n shingles in one order for all texts, the first n - ceil(s n) + 1 hold a
shingle of every text of weighted Jaccard similarity s or more.  A wide radius
then only sorts out unrelated texts; the shingles themselves decide within the
components of the candidates, and groups are built from verified links.

A bucket of any size is compared whole.  Up to ``CELL`` rows form one cell;
beyond, rows are dealt into slices and every pair of slices is a cell of its
own, so no task holds an unbounded bucket.  Slice pairs grow with the square of
the bucket.  Where that costs more rows, a search by an even radius r links a
bucket's rows through their midpoints instead: two fingerprints are within r
exactly if some fingerprint is within r/2 of both, so each row names all those of
its bucket within r/2 of itself, and rows that name the same one are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, free_name, give_back, numbered, partitions, read_table, small_batches, with_row_id, without_rows

#: Rows of a bucket that are compared as one cell; a larger bucket is sliced.
CELL = 512
#: Shingles whose bits are counted at once, which bounds memory for long texts.
STEP = 1 << 15
#: Rows from which a bucket is linked through midpoints, 33 of each row at radius 2: slice pairs would write it more often.
MANY = 33 * CELL
SIMILARITY = 0.8
#: Bits of 256 within which similar texts are looked for.  Expected at 0.8 are 39 with a deviation of 5.7, for 4 against 5
#: shingles 48 (6.2), for two shingles repeated alike 64 (6.9); unrelated texts differ in 128 (8).
RADIUS = 92
#: Shingles of this estimated number of texts and more come last in the order, at most so many of them, estimated from one
#: text in ``DRAWN``.  Any order finds the same pairs; this one keeps buckets small.
COMMON, MOST_COMMON, DRAWN = 256, 200_000, 16
#: Shingles of one slice, and columns that are counted at once, when similarities are verified.
SLICE_SHINGLES, COLUMNS = 1 << 18, 4096
#: Candidates whose row ids are broadcast to the stored shingles; beyond, these shuffle.
BROADCAST_NODES = 1_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of every shingle, repeats included.

    A-Z become a-z, words are split at ASCII white space and joined by one
    space.  A text with fewer words is one shingle; without words, none.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = len(parts) - words + 1
    if n < 1:
        parts, n, words = ([b" ".join(parts)], 1, 1) if parts else ([], 0, 1)
    joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()] if n else []
    stops = (ends - 1).tolist()[words - 1 :]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)


def widen(h: np.ndarray, word: int) -> np.ndarray:
    """The word-th independent 64 bits of each hash; word 0 is the hash itself."""
    if not word:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * word % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """width signed 64-bit words; a bit is 1 if set in over half of the hashes."""
    out = []
    for word in range(width):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), STEP):
            raw = widen(hashes[at : at + STEP], word).astype("<u8", copy=False)
            ones += np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = np.packbits(2 * ones > len(hashes), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


def elements(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct names of a multiset's members: the k-th repeat of a hash is named anew, so set overlap is the shared weight."""
    h = np.sort(hashes)
    at = np.arange(len(h))
    again = at - np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], at, 0)) if len(h) else at
    if not again.any():
        return h
    return np.sort(np.where(again > 0, widen(h ^ widen(again.astype(np.uint64), 1), 1), h))


def _multisets(words: int, width: int):
    """Fingerprints with the shingles themselves (h), their number (size) and a digest of them (i0, i1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                hashes = [shingle_hashes(t.as_py(), words) for t in batch.column("text")]
                prints = [fingerprint(h, width) for h in hashes]
                named = [elements(h) for h in hashes]
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(e.tobytes()), "<i8") for e in named]).reshape(-1, 2)
                offsets = np.cumsum([0, *map(len, named)]).astype(np.int32)
                h = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*named, np.empty(0, np.uint64)]).view(np.int64)))
                cols = [pa.array([p[k] for p in prints], pa.int64()) for k in range(width)]
                cols += [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(e) for e in named], pa.int64()), h]
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), *cols], ["row_id", "doc_id", *(f"f{k}" for k in range(width)), "i0", "i1", "size", "h"])
            give_back()

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def _prefixes(similarity: float, common: np.ndarray):
    """A row a bucket of every text: the first shingles by (common, hash), enough to meet all texts of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys = []
                for h in _lists(batch.column("h")):
                    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
                    late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
                    keys.append(np.concatenate([h[~late], h[late]])[:n])
                nodes = np.repeat(batch.column("row_id").to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, np.int64)])), pa.array(nodes)], ["key", "row_id"])
            give_back()

    return run


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Pairs of element sets of at least the Jaccard similarity, as a Boolean matrix without the diagonal."""
    m, sizes = len(sets), np.array([len(x) for x in sets], float)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    several = np.bincount(column)[column] > 1
    column, owner = column[several], owner[several]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    shared = np.zeros((m, m))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((m, -(-(int(column[b - 1]) + 1 - at) // 64) * 64), bool)
        held[owner[a:b], column[a:b] - at] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for i in range(m):
            shared[i] += np.bitwise_count(bits & bits[i]).sum(axis=1)
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(near, False)
    return near


def _verified(similarity: float):
    """Links of sorted cells of candidates that their shingles bear out."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = forest(similar(sets, similarity)) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch in batches:
            for cell, node, h in zip(zip(batch.column("root").to_pylist(), batch.column("cell").to_pylist()), batch.column("node").to_pylist(), _lists(batch.column("h"))):
                if cell != now:
                    if len(nodes) > 1:
                        yield links(nodes, sets)
                    now, nodes, sets = cell, [], []
                nodes.append(node)
                sets.append(h.copy())
            give_back()
        yield links(nodes, sets)

    return run


def _fingerprints(words: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t.as_py(), words), width) for t in batch.column("text")]
            cols = [pa.array([p[k] for p in prints], pa.int64()) for k in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), *cols], ["row_id", "doc_id", *(f"f{k}" for k in range(width))])

    return run


def exact_tables(radius: int, bits: int = 64) -> list[list[int]]:
    """Bit positions of each table: all pairs of blocks out of radius + 2."""
    edges = [round(i * bits / (radius + 2)) for i in range(radius + 3)]
    blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    return [a + b for a, b in combinations(blocks, 2)]


def _keys(tables: list[list[int]], width: int):
    """A row a table: its number, the bucket, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [np.int64(1) << np.arange(len(t), dtype=np.int64) for t in tables]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                words = np.stack([batch.column(f"f{k}").to_numpy() for k in range(width)], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(words).astype("<i8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").astype(np.int64)
                for k, (at_bits, power) in enumerate(zip(tables, powers)):
                    cols = [pa.array(np.full(len(words), k, np.int32)), pa.array(bits[:, at_bits] @ power), batch.column("node"), *(batch.column(f"f{w}") for w in range(width))]
                    yield pa.RecordBatch.from_arrays(cols, ["tab", "key", "node", *(f"f{w}" for w in range(width))])

    return run


def within(words: np.ndarray, radius: int) -> np.ndarray | None:
    """Pairs of rows at most radius apart, as a Boolean matrix without the diagonal; None if there are none.

    words: (rows, width) of unsigned 64-bit words.
    """
    m, width = words.shape
    lanes = -(-m // 64)
    bits = np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    total = 64 * width
    padded = np.zeros((total, lanes * 64), np.uint8)
    padded[:, :m] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(total, lanes)
    flip = (bits.T.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)).reshape(total, m, 1)
    index = np.arange(m)
    out = np.zeros((m, lanes), np.uint64)  # lanes that cannot count: the row itself and the padding
    out[index, index // 64] |= np.uint64(1) << (index % 64).astype(np.uint64)
    if m % 64:
        out[:, -1] |= np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(m % 64)
    depth = max(2, (radius + 1).bit_length())
    counters = [np.zeros((m, lanes), np.uint64) for _ in range(depth)]
    over = out.copy()  # sticky: the count left the counters

    def exceeds() -> np.ndarray:
        more, same = over.copy(), ~over
        for level in range(depth - 1, -1, -1):
            if radius >> level & 1:
                same &= counters[level]
            else:
                more |= same & counters[level]
                same &= ~counters[level]
        return more

    for at in range(0, total, 3):
        a, b, c = (planes[p] ^ flip[p] if p < total else np.uint64(0) for p in (at, at + 1, at + 2))
        half = a ^ b
        ones, twos = half ^ c, (a & b) | (half & c)
        carry = counters[0] & ones
        counters[0] ^= ones
        mixed = counters[1] ^ twos
        up = (counters[1] & twos) | (mixed & carry)
        counters[1] = mixed ^ carry
        for level in range(2, depth):
            nxt = counters[level] & up
            counters[level] ^= up
            up = nxt
        over |= up
        if at % 24 == 21 and at > 2 * radius and np.all(exceeds() == np.uint64(0xFFFFFFFFFFFFFFFF)):
            return None
    near = ~exceeds()
    if not near.any():
        return None
    return np.unpackbits(near.astype("<u8").view(np.uint8).reshape(m, -1), axis=1, bitorder="little")[:, :m].astype(bool)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(row, smallest row of its component) of a Boolean matrix, without the smallest rows themselves."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        least = least[least]
        if np.array_equal(least, label):
            return [(i, int(x)) for i, x in enumerate(label) if i != x]
        label = least


def _links(width: int, radius: int):
    """Compares sorted cells; small cells share a block, for a link across two buckets is a link too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"f{k}" for k in range(width)]

        def compare(nodes: np.ndarray, words: np.ndarray) -> pa.RecordBatch | None:
            near = within(words, radius)
            if near is None:
                return None
            pairs = forest(near)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

        rest: tuple | None = None

        def cut(keys: np.ndarray, nodes: np.ndarray, words: np.ndarray, last: bool):
            """Blocks of whole cells; the cell at the end may go on in the next batch."""
            change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            bounds = [0, *change.tolist(), len(keys)]
            stop, begin = len(bounds) - (1 if last else 2), 0
            for i in range(stop):
                if i + 1 == stop or bounds[i + 2] - bounds[begin] > CELL:
                    yield slice(bounds[begin], bounds[i + 1])
                    begin = i + 1

        def blocks(batch_stream):
            nonlocal rest
            for batch in batch_stream:
                if not batch.num_rows:
                    continue
                got = (np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tab", "key", "cell")], axis=1), batch.column("node").to_numpy(), np.stack([batch.column(n).to_numpy() for n in names], axis=1).astype("<i8").view("<u8"))
                if rest is not None:
                    got = tuple(np.concatenate(x) for x in zip(rest, got))
                end = 0
                for s in cut(*got, last=False):
                    yield got[1][s], got[2][s]
                    end = s.stop
                rest = tuple(x[end:] for x in got)
            if rest is not None and len(rest[0]):
                for s in cut(*rest, last=True):
                    yield rest[1][s], rest[2][s]

        for nodes, words in blocks(batches):
            if len(nodes) > 1 and (made := compare(nodes, words)) is not None:
                yield made

    return run


def _pairs(own: str, slices: str) -> Column:
    """The cells of a row in slice ``own``: slice pairs (i, j), i <= j, are numbered i * slices + j."""
    return F.transform(F.sequence(F.lit(0), F.col(slices) - 1), lambda j: F.least(j, F.col(own)).cast("long") * F.col(slices) + F.greatest(j, F.col(own)))


def _by_midpoints(scratch: Scratch, hot: DataFrame, tables: list[list[int]], radius: int) -> DataFrame:
    """Links (a, b) that connect all rows (tab, node, f0) of a bucket that are within an even radius; none between others."""
    flips = []
    for table in tables:
        free = [b for b in range(64) if b not in set(table)]
        some = [sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(free, k)]
        flips.append(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in some]))
    named = hot.select("tab", "node", "f0", F.explode(F.element_at(F.array(*flips), F.col("tab") + 1)).alias("flip")).select("node", F.col("f0").bitwiseXOR(F.col("flip")).alias("mid"))
    hubs = scratch.write(named.groupBy("mid").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("mid", "hub"), "hubs")
    return named.join(hubs, "mid").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def _prefix_keys(scratch: Scratch, prints: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(tab, key, node) of all buckets of the distinct texts."""
    drawn = prints.where(F.pmod(F.xxhash64("row_id"), F.lit(DRAWN)) == 0).select(F.explode("h").alias("key"))
    common = drawn.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON // DRAWN).orderBy(F.desc("n"), "key").limit(MOST_COMMON)
    common = np.sort(np.array([r.key for r in common.select("key").collect()], np.int64))
    keyed = prints.select("row_id", "h").mapInArrow(_prefixes(similarity, common), "key long, row_id long")
    nodes = distinct.select(F.col("node").alias("row_id"))
    return keyed.join(nodes, "row_id", "left_semi").select(F.lit(0).alias("tab"), "key", F.col("row_id").alias("node"))


def _verify(scratch: Scratch, prints: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Links that hold by the shingles, among the members of every component of candidates."""
    members = scratch.write(components(scratch, links), "members")
    sets = prints.select(F.col("row_id").alias("node"), "size", "h").join(F.broadcast(members) if members.count() <= BROADCAST_NODES else members, "node")
    sets = scratch.write(sets, "sets")
    sizes = scratch.write(sets.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("size") / SLICE_SHINGLES)).cast("int").alias("slices")), "sizes")
    dealt = sets.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    cells = dealt.select("root", F.explode(_pairs("own", "slices")).alias("cell"), "node", "h")
    cells = cells.repartition(partitions(scratch.spark), "root", "cell").sortWithinPartitions("root", "cell")
    with small_batches(scratch.spark, 256):
        return scratch.write(cells.mapInArrow(_verified(similarity), "a long, b long").distinct(), "verified")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, shingle_words: int = 5, width: int = 4, radius: int = RADIUS, similarity: float | None = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, f0.. (signed words of the fingerprint), component_id, keeper_row, and size with a similarity.

    Documents link when the weighted Jaccard similarity of their shingles is at
    least ``similarity``, and groups are the connected components of the links.
    Fingerprints are only asked whether a pair is worth a look: it is left out
    beyond ``radius`` of 64 * ``width`` bits.  All other pairs are found.
    Without a similarity, documents link within the radius, an exact search for
    width 1 and radii up to 3.
    component_id is the smallest doc_id of the group (null only if all are
    null), keeper_row the row_id of one document of the group, that with the
    smallest doc_id.  size is the number of shingles, repeats included.

    Null and wordless texts have fingerprint zero, linked like any other.
    Repeated rows share a fingerprint.  Texts of any length are read whole.
    Other columns, whatever their names, are ignored.  An empty table gives an
    empty result.
    """
    return _groups(Scratch(spark, "simhash"), with_row_id(docs.select("doc_id", "text")), shingle_words, width, radius, similarity)


def _groups(scratch: Scratch, rows: DataFrame, shingle_words: int = 5, width: int = 4, radius: int = RADIUS, similarity: float | None = SIMILARITY) -> DataFrame:
    """:func:`near_duplicates` of (row_id, doc_id, text), which one job reads."""
    if similarity is None and (width != 1 or radius > 3):
        raise ValueError("a search by radius alone takes width 1 and a radius up to 3")
    spark = scratch.spark
    words = [f"f{k}" for k in range(width)]
    sig = ", ".join(f"{w} long" for w in words)
    if similarity is None:
        fold, more = words, []
        made = rows.mapInArrow(_fingerprints(shingle_words, width), f"row_id long, doc_id long, {sig}")
    else:
        fold, more = ["i0", "i1"], ["size"]
        made = rows.mapInArrow(_multisets(shingle_words, width), f"row_id long, doc_id long, {sig}, i0 long, i1 long, size long, h array<long>")
    with small_batches(spark):
        prints = scratch.write(made, "prints")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_id")
    same = [F.first(w).alias(w) for w in words if w not in fold]  # equal shingles have equal fingerprints
    distinct = scratch.write(prints.groupBy(*fold).agg(F.min("row_id").alias("node"), F.min(order).alias("least"), *same), "distinct")
    if similarity is None:
        keyed = distinct.select("node", *words).mapInArrow(_keys(exact_tables(radius), width), f"tab int, key long, node long, {sig}")
    else:
        keyed = _prefix_keys(scratch, prints, distinct, similarity)
    with small_batches(spark):
        keyed = scratch.write(keyed, "keyed")
    # aggregates are stored before they are joined: with plain shuffles on both sides a hot key's rows can be split
    crowded = scratch.write(keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    halves = similarity is None and radius % 2 == 0
    many = crowded.where(F.col("n") > MANY)
    slices = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("node"), slices).cast("int")
    met = keyed.join(crowded.where(F.col("n") <= MANY) if halves else crowded, ["tab", "key"]).withColumn("slices", slices).withColumn("own", own)
    if similarity is not None:
        met = met.join(distinct.select("node", *words), "node")
    cells = met.select("tab", "key", F.explode(_pairs("own", "slices")).alias("cell"), "node", *words)
    dealt = cells.repartition(partitions(spark), "tab", "key", "cell").sortWithinPartitions("tab", "key", "cell")
    links = scratch.write(dealt.mapInArrow(_links(width, radius), "a long, b long").distinct(), "links")
    if halves and not many.isEmpty():
        hot = keyed.join(many.select("tab", "key"), ["tab", "key"])
        links = links.union(scratch.write(_by_midpoints(scratch, hot, exact_tables(radius), radius), "links-mid"))
    scratch.drop("keyed", "crowded")
    if similarity is not None:
        links = _verify(scratch, prints, links, similarity)
        scratch.drop("members", "sets", "sizes")
    roots = components(scratch, links)
    named = scratch.write(distinct.join(roots, "node", "left").select(*fold, "least", F.coalesce("root", "node").alias("root")), "named")
    groups = scratch.write(named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first"), "groups")
    first = F.coalesce("first", "least")
    told = named.join(groups, "root", "left").select(*fold, first["doc_id"].alias("component_id"), first["row_id"].alias("keeper_row"))
    return prints.select("row_id", "doc_id", *words, *more, *[c for c in fold if c not in words]).join(scratch.write(told, "told"), fold).select("row_id", "doc_id", *words, "component_id", "keeper_row", *more)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that stay when one document of each group does, all columns as they were.

    Texts without words are not near-copies of anything here: they all stay.
    """
    scratch, mark = Scratch(spark, "simhash"), free_name(docs, "tidewright_row")
    rows = numbered(scratch, docs, mark)
    groups = _groups(scratch, rows.select(F.col(mark).alias("row_id"), "doc_id", "text"))
    return without_rows(scratch, rows, mark, groups.where((F.col("keeper_row") != F.col("row_id")) & (F.col("size") > 0)).select("row_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 64 bits, radius 2, exact search: one row per row of ``documents``.

    Texts without words have fingerprint zero and link like any other.
    component_id is null only where no linked row has a doc_id.
    """
    found = near_duplicates(spark, read_table(spark, sf_dir, "documents"), shingle_words=3, width=1, radius=2, similarity=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
