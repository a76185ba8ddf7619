"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item of n shingles is looked for in every window of n shingles of
every document; a document of fewer shingles is one window.  Both sides get
128-bit SimHash fingerprints.  The counters of a window's bits lie packed in a few
longs and roll along the document, one shingle in and one out at each step.

The index holds the items: of each of their ``BLOCKS`` blocks of 16 bits, every
value within ``FLIPS`` flipped bits, together with the item's size.  Two
fingerprints within ``RADIUS`` differ by at most ``FLIPS`` bits in some block, so
the equi-join of windows on (size, block, bits) finds all of them; a pair comes
out of the join once, by the first block that tells of it, and only within the
radius.  Candidates are then verified by the exact weighted Jaccard similarity of
their shingle multisets (shingles are compared by their 64-bit hashes).

Ahead of all this, a bound skips windows: one can only reach the similarity if
enough of its shingles occur in the benchmark at all (w shared ones weigh at most
w over size + n - w).  Everything is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, numbered, read_table, small, with_row_id, without_rows

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words a fingerprint, bits a block, and bits that may differ within a block.
WORDS, BLOCK, FLIPS = 2, 16, 3
BLOCKS = WORDS * 64 // BLOCK
#: Any two fingerprints at most this far apart have a block with FLIPS differing bits or fewer.  Expected at similarity 0.8
#: are 19.4 bits with a deviation of 4.1, so this is three deviations more.
RADIUS = (FLIPS + 1) * BLOCKS - 1
#: Rows of shingles of items that are broadcast; a hashed row takes some 100 bytes, so 40 MB at most.  Beyond, joins shuffle.
BROADCAST_SHINGLES = 400_000


def _words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; case, punctuation and spacing don't hide a passage."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Replaces ``text`` by ``h``: hashes of all k-word shingles in order, of the whole text if it has fewer words, none without words.

    Each step is a projection of its own, so that no expression is evaluated again for every element.
    """
    rest = [c for c in df.columns if c != "text"]
    hashed = df.select(*rest, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    rolled = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(F.col("w"), i + (j - 1)) for j in range(k)]))
    short = F.array(F.xxhash64(F.array_join("w", " ")))
    return hashed.select(*rest, F.when(F.size("w") == 0, F.array().cast("array<long>")).when(F.size("w") < k, short).otherwise(rolled).alias("h"))


def lane_bits(longest: int) -> int:
    """Width of the counters that lie side by side in a long: wide enough for a window of the longest item, clear of the sign."""
    return 16 if longest < 1 << 15 else 32


def _lane(x: str, k: str, wide: int) -> str:
    """Every ``wide``-th bit of a hash from bit k on, each in a counter of its own."""
    return f"(shiftrightunsigned({x}, {k}) & {sum(1 << at for at in range(0, 64, wide))}L)"


def _counted(hashes: str, wide: int) -> str:
    """Sums of all lanes of an array of hashes."""
    return f"transform(sequence(0, {wide - 1}), k -> aggregate({hashes}, 0L, (a, x) -> a + {_lane('x', 'k', wide)}))"


def _word(sums: str, size: str, wide: int) -> str:
    """A fingerprint's word from summed lanes: a bit is 1 if set in over half of the shingles."""
    count = f"(shiftrightunsigned({sums}[b % {wide}], b - b % {wide}) & {(1 << wide) - 1}L)"
    return f"aggregate(sequence(0, 63), 0L, (a, b) -> a | if(2 * {count} > {size}, shiftleft(1L, b), 0L))"


def _rolled(hashes: str, wide: int) -> str:
    """Words of all windows of ``size`` hashes along an array: the counters take one shingle in and one out at each step."""
    steps = f"if(size({hashes}) > size, sequence(1, size({hashes}) - size), cast(array() as array<int>))"
    moved = f"transform(sequence(0, {wide - 1}), k -> st.sums[k] + {_lane(f'{hashes}[i + size - 1]', 'k', wide)} - {_lane(f'{hashes}[i - 1]', 'k', wide)})"
    begin = f"named_struct('sums', {_counted(f'slice({hashes}, 1, size)', wide)}, 'words', cast(array() as array<bigint>))"
    done = f"array_append(st.words, {_word('st.sums', 'size', wide)})"
    return f"aggregate({steps}, {begin}, (st, i) -> named_struct('sums', {moved}, 'words', {done}), st -> {done})"


def blocks(words: list[str]) -> list[str]:
    """The fingerprint's blocks as integers, in SQL."""
    return [f"cast(shiftrightunsigned({w}, {at}) & {(1 << BLOCK) - 1}L as int)" for w in words for at in range(0, 64, BLOCK)]


def masks() -> list[int]:
    """All ways to flip up to FLIPS bits of a block."""
    return [sum(1 << b for b in some) for k in range(FLIPS + 1) for some in combinations(range(BLOCK), k)]


def least_shared(n: Column, size: Column, similarity: float) -> Column:
    """Shingles that a window of the size must share with an item of n to reach the similarity."""
    return F.ceil((n + size) * (similarity / (1 + similarity)) - 1e-9).cast("int")


def _second(hashes: str) -> Column:
    """Independent hashes for a fingerprint's second word."""
    return F.expr(f"transform({hashes}, x -> xxhash64(x, 1))")


def _item_prints(items: DataFrame, wide: int) -> DataFrame:
    """(item, n, g0, g1): the items' fingerprints."""
    counted = items.select("item", "n", "h", _second("h").alias("h1")).select("item", "n", *[F.expr(_counted(h, wide)).alias(f"c{k}") for k, h in enumerate(("h", "h1"))])
    return counted.select("item", "n", *[F.expr(_word(f"c{k}", "n", wide)).alias(f"g{k}") for k in range(WORDS)])


def _starts(similarity: float) -> Column:
    """Starts of the windows with enough hits, from a stretch's sorted hit positions: linear in the hits.

    The i-th hit and the need - 1 after it lie in the windows that start in
    [last - size + 1, first]; what the hit before has told of is left out.
    """
    need, top = F.col("need"), F.least(F.col("first") + F.col("n") * 4 - 1, F.col("total") - F.col("size"))

    def of(i: Column) -> Column:
        low = F.greatest(F.get("hit", i + need - 1) - F.col("size") + 1, F.coalesce(F.get("hit", i - 1) + 1, F.lit(0)), F.col("first"))
        high = F.least(F.get("hit", i), top)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("hit") - need), of))


def _windows(rows: DataFrame, vocabulary: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(row_id, doc_id, n, size, part, windows): starts of the windows that the bound lets through, by stretch."""
    texts = with_shingles(rows.select("row_id", "doc_id", "text"), shingle)
    # the outer form: an inner explode would put a filter on h, and with it all of h's expression, below the projections
    hits = texts.select("row_id", "doc_id", F.size("h").alias("total"), F.posexplode_outer("h").alias("pos", "shingle")).join(vocabulary, "shingle")
    hits = hits.select("row_id", "doc_id", "total", "pos", F.explode("sizes").alias("n"))
    hits = hits.where(F.col("total") >= F.ceil(F.col("n") * similarity - 1e-9))
    # hits of a document and size, cut into stretches of 4 n positions that overlap by a window
    stride = F.col("n") * 4
    own = F.floor(F.col("pos") / stride).cast("int")
    both = F.when((F.col("pos") % stride < F.col("n")) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    parts = hits.withColumn("part", F.explode(both)).groupBy("row_id", "doc_id", "total", "n", "part").agg(F.sort_array(F.collect_list("pos")).alias("hit"))
    parts = parts.withColumns({"size": F.least("n", "total"), "first": F.col("part") * F.col("n") * 4})
    parts = parts.withColumn("need", least_shared(F.col("n"), F.col("size"), similarity)).where(F.size("hit") >= F.col("need"))
    return parts.select("row_id", "doc_id", "n", "size", "part", _starts(similarity).alias("windows")).where(F.size("windows") > 0)


def _prints(parts: DataFrame, wide: int) -> DataFrame:
    """(row_id, doc_id, n, size, part, window, f0, f1): fingerprints of the windows, by counters that roll along each stretch."""
    key = ["row_id", "doc_id", "n", "size", "part"]
    rolled = parts.select(*key, "low", "windows", "s", _second("s").alias("s1")).select(*key, "low", "windows", *[F.expr(_rolled(h, wide)).alias(f"w{k}") for k, h in enumerate(("s", "s1"))])
    each = "transform(windows, w -> struct(w as window, w0[w - low] as f0, w1[w - low] as f1))"
    return rolled.select(*key, F.explode(F.expr(each)).alias("p")).select(*key, "p.window", "p.f0", "p.f1")


def _candidates(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Windows and items within the radius, each pair once."""
    f, g = [[f"{x}{w}" for w in range(WORDS)] for x in "fg"]
    cut = lambda words: F.expr(f"explode(array({', '.join(f'struct({k} as block, {b} as bits)' for k, b in enumerate(blocks(words)))}))")
    flips = F.expr(f"explode(transform(array({', '.join(map(str, masks()))}), m -> b.bits ^ m))")
    index = items.select("item", "n", *g, cut(g).alias("b")).select("item", "n", *g, "b.block", flips.alias("bits"))
    keyed = prints.select("*", cut(f).alias("b")).select(*prints.columns, "b.block", "b.bits")
    differ = [f"({a} ^ {b})" for a, b in zip(f, g)]
    hamming = F.expr(" + ".join(f"bit_count({d})" for d in differ))
    telling = F.expr(f"array_position(array({', '.join(f'bit_count({b}) <= {FLIPS}' for b in blocks(differ))}), true) - 1")
    # a shuffle unless its real size is small: an estimate would leave the flips out and broadcast an index of any size
    met = keyed.join(index.hint("merge"), ["n", "block", "bits"]).where((telling == F.col("block")) & (hamming <= RADIUS))
    return met.select("row_id", "doc_id", "n", "size", "part", "window", "item", hamming.alias("hamming"))


def find_contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, told: dict[str, int] | None = None
) -> DataFrame:
    """Matches as (row_id, doc_id, item_id, window, n_shingles, hamming, similarity), the best window of each document and item.

    window is the first shingle of the window from 0, the leftmost of the best,
    n_shingles its length: the item's, or the document's if that has fewer.
    Null and wordless texts and items match nothing; items of fewer words than a
    shingle are one shingle, and match documents of just those words.  Texts of
    any length are searched whole, in stretches of four item lengths.  Repeated
    items and rows are all reported.  Other columns, whatever their names, are
    ignored.  Empty tables give an empty result.  ``told`` receives the numbers
    of windows, of candidates and of matches.
    """
    scratch, mark = Scratch(spark, "decontaminate"), free_name(docs, "tidewright_row")
    return _find(scratch, numbered(scratch, docs, mark).select(F.col(mark).alias("row_id"), "doc_id", "text"), benchmark, shingle, similarity, told)


def _find(scratch: Scratch, rows: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, told: dict[str, int] | None = None) -> DataFrame:
    items = with_shingles(with_row_id(benchmark.select("item_id", "text"), "item"), shingle).where(F.size("h") > 0)
    items = scratch.write(items.withColumn("n", F.size("h")), "items")
    # a size is looked for where shingles of items of that size occur
    vocabulary = items.select("n", F.explode("h").alias("shingle")).groupBy("shingle").agg(F.array_sort(F.collect_set("n")).alias("sizes"))
    vocabulary = scratch.write(vocabulary, "vocabulary")
    spans = scratch.write(_windows(rows, small(vocabulary, BROADCAST_SHINGLES), shingle, similarity), "spans")
    # the windows' other shingles, from the documents that have any window; only these are cut up again
    wanted = scratch.write(spans.select("row_id").distinct(), "wanted")
    full = with_shingles(rows.select("row_id", "text").join(small(wanted), "row_id", "left_semi"), shingle)
    low, high = F.array_min("windows"), F.array_max("windows") + F.col("size")
    parts = spans.join(full, "row_id").select("row_id", "doc_id", "n", "size", "part", "windows", low.alias("low"), F.slice("h", low + 1, high - low).alias("s"))
    parts = scratch.write(parts, "parts")
    wide = lane_bits(items.agg(F.max("n")).first()[0] or 0)
    prints = scratch.write(_prints(parts, wide), "prints")
    pairs = scratch.write(_candidates(prints, _item_prints(items, wide)), "pairs")
    matches = _verify(parts, items, pairs, similarity)
    if told is not None:
        matches = scratch.write(matches, "matches")
        told |= {"windows": prints.count(), "candidates": pairs.count(), "matches": matches.count()}
    return matches


def _verify(parts: DataFrame, items: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The best window of each document and item that reaches the similarity, by shared weight: the sum of smaller counts."""
    key = ["row_id", "doc_id", "n", "size", "window", "item", "hamming"]
    inside = F.explode(F.slice("s", F.col("window") - F.col("low") + 1, F.col("size")))
    held = pairs.join(parts.select("row_id", "n", "part", "low", "s"), ["row_id", "n", "part"]).select(*key, inside.alias("s")).groupBy(*key, "s").agg(F.count("*").alias("here"))
    own = items.select("item", "item_id", F.explode("h").alias("s")).groupBy("item", "item_id", "s").agg(F.count("*").alias("there"))
    shared = held.join(own, ["item", "s"]).groupBy(*key, "item_id").agg(F.sum(F.least("here", "there")).alias("shared"))
    judged = shared.withColumn("similarity", F.col("shared") / (F.col("size") + F.col("n") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("window")).alias("back"), "size", "hamming")).alias("b")
    return judged.groupBy("row_id", "doc_id", "item", "item_id").agg(best).select(
        "row_id", "doc_id", "item_id", (-F.col("b.back")).alias("window"), F.col("b.size").alias("n_shingles"), F.col("b.hamming").cast("int").alias("hamming"), F.col("b.similarity").alias("similarity")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a match, all columns as they were."""
    scratch, mark = Scratch(spark, "decontaminate"), free_name(docs, "tidewright_row")
    rows = numbered(scratch, docs, mark)
    found = _find(scratch, rows.select(F.col(mark).alias("row_id"), "doc_id", "text"), benchmark)
    return without_rows(scratch, rows, mark, found.select("row_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: five words, similarity 0.8."""
    return find_contamination(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("row_id")
