"""Chat formatting after collapse of cumulative snapshots.

Logs often hold a conversation again after every turn.  Each turn gets a hash of
(place, role, text); the hash of a prefix is the XOR of its turns' hashes, so it
rolls forward turn by turn and a running aggregate gives all prefixes.  A
conversation whose full hash is a proper prefix of another is a snapshot of it,
and an anti-join drops it; of conversations equal as a whole the smallest
conv_id stays.  What is left is rendered.

Hashes are two independent 64-bit ones side by side.  Turns are numbered in
chunks, so a conversation with very many turns is spread over many tasks, and
prefixes are made distinct before the join, so a common opening meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

#: Turn numbers a chunk.
CHUNK = 128


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns of each conversation with their place from 1, and the prefix hashes at each."""
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(1 << 62)).cast("long")))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    return rows.withColumn("rank", F.row_number().over(inside)).join(sizes, ["conv_id", "chunk"]).select(
        "conv_id", "chunk", "turn", "role", "text", (F.col("base") + F.col("rank")).alias("place")
    )


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", "role", F.octet_length("role"), "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, ha, hb): the hashes of the first ``place`` turns."""
    own = turns.select("conv_id", "chunk", "place", _hash(1).alias("a"), _hash(2).alias("b"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0).cast("long"))
    chunks = own.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"))
    chunks = chunks.select("conv_id", "chunk", xor("ca", before).alias("pa"), xor("cb", before).alias("pb"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = own.select("conv_id", "chunk", "place", xor("a", inside).alias("a"), xor("b", inside).alias("b")).join(chunks, ["conv_id", "chunk"])
    return rolled.select("conv_id", "place", F.col("a").bitwiseXOR(F.col("pa")).alias("ha"), F.col("b").bitwiseXOR(F.col("pb")).alias("hb"))


def format_chats(spark: SparkSession, conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>\n") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, text, n_equal.

    text is ``begin + role + "\\n" + text + end`` for every turn in order.
    n_equal counts the conversations equal as a whole, the kept one included.
    Turns are ordered by (turn, role, text), null turns first; null roles and
    texts are empty; identical rows of a conversation count once.  Rows without
    conv_id belong to no conversation and are left out.  Only ``conv_id``,
    ``turn``, ``role`` and ``text`` are read; other columns, whatever their
    names, are ignored.  An empty table gives an empty result.  Texts of any
    length are rendered whole: a task holds one conversation at a time, which
    must fit into memory as its rendered text does.
    """
    scratch = Scratch(spark, "chat")
    turns = scratch.write(_turns(conversations), "turns")
    prefixes = scratch.write(prefix_hashes(turns), "prefixes")
    # stored, so that the join has a plain shuffle on both sides and a long conversation's rows can be split
    sizes = scratch.write(prefixes.groupBy("conv_id").agg(F.max("place").alias("n")), "sizes")
    marked = prefixes.join(sizes, "conv_id")
    whole = marked.where("place = n").groupBy("place", "ha", "hb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    proper = marked.where("place < n").select("place", "ha", "hb").distinct()
    maximal = whole.join(proper, ["place", "ha", "hb"], "left_anti").select("conv_id", "n_equal")
    piece = F.concat(F.lit(begin), "role", F.lit("\n"), "text", F.lit(end))
    rendered = turns.join(maximal, "conv_id").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))), lambda t: t["piece"]), "").alias("text"),
        F.first("n_equal").alias("n_equal"),
    )
    return rendered


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark, read_table(spark, sf_dir, "conversations"))


OP4_SQL = """
with t as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from t
), p as (
  select conv_id, place,
         string_agg(sha256(place || ':' || length(role) || ':' || role || text), ',') over (partition by conv_id order by place) as prefix
  from n
), s as (select conv_id, max(place) as n from n group by conv_id),
whole as (
  select min(conv_id) as conv_id, count(*) as n_equal, prefix from p join s using (conv_id) where place = n group by prefix
), maximal as (
  select conv_id, n_equal from whole where prefix not in (select prefix from p join s using (conv_id) where place < n)
)
select n.conv_id, count(*) as n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by place) as text,
       any_value(n_equal) as n_equal
from n join maximal on n.conv_id = maximal.conv_id group by n.conv_id
"""
