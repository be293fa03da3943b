"""Chat formatting by cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation again and again as it grows. The turns of a conversation are numbered and each
gets a hash of (position, role, text); the exclusive-or of the hashes of turns 1..n is a rolling hash of that
prefix, so all prefixes of all conversations come from running window aggregates. Conversations whose full hash
is a proper prefix of another are removed by an anti-join against the distinct prefixes; of equal conversations
the smallest conv_id stays. What is left is rendered.

Turns are cut into blocks of ``block_turns`` by turn number; positions and hashes run within blocks and are
shifted by running sums over blocks, and the rendered text comes in parts of ``part_turns`` turns. So a
conversation that holds a third of all rows is never in one task as a whole.

Defined cases: identical repeated rows count once; different rows with the same turn follow in order of role,
then text; a null turn comes first; null role and text render as empty and differ from empty ones in hashes; rows with
a null conv_id form one conversation; the opening of a marker inside a text is broken by a space; very long texts are
rendered whole; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def numbered(turns: DataFrame, block_turns: int) -> DataFrame:
    """Distinct turns with pos (1, 2, ...), n (turns of the conversation) and the prefix hashes p1, p2."""
    turns = turns.select("conv_id", "turn", "role", "text").distinct()
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    counts = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    blocks = Window.partitionBy("conv_id").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "shift", "n")
    at = turns.join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    at = at.withColumn("pos", F.row_number().over(inside) + F.col("shift"))
    at = at.withColumn("x1", _hash(1)).withColumn("x2", _hash(2))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("w1", F.bit_xor("x1").over(upto)).withColumn("w2", F.bit_xor("x2").over(upto))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id of the conversations that stay, from numbered turns."""
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)).alias("s1"), F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)).alias("s2"))
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    rows = rows.select("conv_id", "pos", "n", F.col("w1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("w2").bitwiseXOR(F.col("s2")).alias("p2"))
    whole = rows.where("pos = n").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = rows.where("pos < n").select("pos", "p1", "p2").distinct()
    return whole.join(prefixes, ["pos", "p1", "p2"], "left_anti").select("conv_id")


def render(turns: DataFrame, *, block_turns: int = 256, part_turns: int = 256) -> DataFrame:
    """Maximal conversations as text: conv_id, part (0, 1, ...), n_turns (of the conversation), text.

    The parts of a conversation, in order and without anything between, are its text; all but the longest
    conversations have one.
    """
    rows = materialize(numbered(turns, block_turns))
    stay = maximal(rows).select(F.col("conv_id").alias("c"))
    rows = rows.join(stay, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    safe = lambda name: F.replace(F.coalesce(name, F.lit("")), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE + "\n"))
    rows = rows.select("conv_id", "n", "pos", F.floor((F.col("pos") - 1) / part_turns).alias("part"), line.alias("line"))
    parts = rows.groupBy("conv_id", "n", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return parts.select("conv_id", "part", F.col("n").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
