"""Cumulative-snapshot collapse of logged conversations, with built-in DataFrame functions only.

Chat loggers often store a conversation again after each turn. Every turn gets a hash of all turns up to it: a sum of
position-tagged turn hashes, which can be added up block by block, so a very long conversation is never in one task.
A conversation whose last hash is an inner prefix hash of another is a snapshot of it and goes; of equal conversations
the one with the smallest id stays. What is left is rendered in chunks of turns.

Turns are ordered by turn, role and text. Turns that repeat (same conversation, number, role and text) count once. Null
role and text count as empty, a null turn comes first, and rows with a null conv_id form one conversation, which ranks
after the others. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stow

#: Turns in a block of the prefix sums, and in a rendered chunk.
BLOCK, CHUNK = 64, 64
KEY = ["known", "conv"]


def _parts(*hashes):
    """Each 64-bit hash as two 32-bit numbers, whose sums can't overflow."""
    return [p for h in hashes for p in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def prefixes(conversations: DataFrame) -> DataFrame:
    """known, conv, pos (from 1), total (turns), p1 and p2 (hash of the turns up to pos), role, text."""
    c = conversations
    rows = c.select(c["conv_id"].isNotNull().alias("known"), F.coalesce(c["conv_id"].cast("long"), F.lit(0)).alias("conv"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy(*KEY, "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rn", F.row_number().over(inside))
    starts = rows.groupBy(*KEY, "block").count().select(*KEY, "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(Window.partitionBy(*KEY)).alias("total"))
    placed = rows.join(starts, [*KEY, "block"]).withColumn("pos", F.col("start") + F.col("rn"))
    tags = _parts(F.xxhash64("pos", "role", F.lit(0), "text"), F.xxhash64(F.lit(1), "text", "pos", "role"))
    tagged = placed.select("*", *(t.alias(f"t{i}") for i, t in enumerate(tags)))
    sums = [f"s{i}" for i in range(len(tags))]
    by_block = tagged.groupBy(*KEY, "block").agg(*(F.sum(f"t{i}").alias(s) for i, s in enumerate(sums)))
    earlier = by_block.select(*KEY, "block", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in sums))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = tagged.select("*", *(F.sum(f"t{i}").over(running).alias(f"r{i}") for i in range(len(tags)))).join(earlier, [*KEY, "block"])
    whole = [F.col(f"r{i}") + F.col(s) for i, s in enumerate(sums)]
    return summed.select(*KEY, "pos", "total", F.xxhash64(*whole).alias("p1"), F.xxhash64(F.lit(5), *reversed(whole)).alias("p2"), "role", "text")


def collapse(conversations: DataFrame, block_rows: int = CHUNK) -> DataFrame:
    """Per maximal conversation and chunk of its turns: conv_id, chunk (from 0), n_turns, n_copies, rendered."""
    turns = stow(prefixes(conversations))
    inner = turns.where("pos < total").select("pos", "p1", "p2").distinct()
    whole = turns.where("pos = total").groupBy("pos", "p1", "p2").agg(F.min(F.struct(~F.col("known"), F.col("conv"))).alias("first"), F.count("*").alias("n_copies"))
    kept = whole.join(inner, ["pos", "p1", "p2"], "left_anti").select((~F.col("first")["col1"]).alias("known"), F.col("first")["conv"].alias("conv"), "n_copies")
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = turns.join(kept, KEY).select(*KEY, F.floor((F.col("pos") - 1) / block_rows).alias("chunk"), "total", "n_copies", F.struct("pos", line.alias("line")).alias("turn"))
    chunks = rows.groupBy(*KEY, "chunk", "total", "n_copies").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return chunks.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), "chunk", F.col("total").alias("n_turns"), "n_copies", F.array_join(F.col("turns")["line"], "").alias("rendered"))


SQL = """
with rows as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
placed as (select *, row_number() over w as pos, count(*) over (partition by conv_id) as total from rows window w as (partition by conv_id order by turn nulls first, role, text)),
prefix as (select *, md5(string_agg(md5(role || chr(10) || text), '') over (partition by conv_id order by pos)) as p from placed),
whole as (select p, pos, min(conv_id) as conv_id, count(*) as n_copies from prefix where pos = total group by p, pos),
kept as (select * from whole where not exists (select 1 from prefix i where i.pos < i.total and i.p = whole.p and i.pos = whole.pos))
select k.conv_id, cast((t.pos - 1) // 64 as bigint) as chunk, cast(t.total as bigint) as n_turns, cast(k.n_copies as bigint) as n_copies,
  string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' order by t.pos) as rendered
from kept k join prefix t on t.conv_id is not distinct from k.conv_id group by all
"""
