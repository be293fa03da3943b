"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

1. The words of every document are counted and summed by (source, hash bucket); all later tables are made
   from these sums.
2. Sources, by code point with null last, weigh ``weights`` in turn. The total of all sizes is shared by
   weight; a target stops at ``max_repeats`` times its source's size and the excess is shared anew by weight.
   With the level at which a source stops (cap / weight) sorted, this is one pass of running sums.
3. ``total / block_words`` equal blocks go to the sources by highest quotients target / (2 seats + 1). Seats
   that any such allotment contains are computed in closed form; the rest, at most as many as there are
   sources, are awarded by explicit quotients. The quota of a source goes to its shards, of about
   ``shard_words`` words each, in the same way by shard size.
4. In each shard, documents stand in a seeded order and their words form one stream of blocks. A shard takes
   its quota of blocks from the front of that stream, going round as often as needed.

A shard is the only group that meets in one task. It is bounded by ``shard_words`` as long as one hash
bucket is, so a source that holds a third of all rows is cut into many shards.

Defined cases: null and empty texts have size 0 and are never taken; a source of size 0 has target 0; null is
a source of its own; very long texts count whole; a doc_id that is null or no number is ordered as -1; equal (doc_id, size) pairs are ordered by a hash of the
text and, if they are equal in all, are interchangeable; columns of the input that clash with the added ones
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, discard, materialize, small, without

BUCKETS = 16_384


def _seeded(doc_id: Column, seed: int) -> Column:
    """A permutation-like 31-bit hash by integer steps that any SQL engine has."""
    x = F.pmod(F.coalesce(doc_id.try_cast("long"), F.lit(-1)), F.lit(2147483647)) + F.lit(seed % 2147483647)
    for factor in (48271, 69621):
        x = F.pmod(x * F.lit(factor) + F.lit(12345), F.lit(2147483647))
        x = F.pmod(F.shiftright(x, 15).bitwiseXOR(x) * F.lit(16807), F.lit(2147483647))
    return x


def apportion(table: DataFrame, within: list[str], key: str, out: str) -> DataFrame:
    """Sainte-Lague by highest quotients in each group of ``within``: adds the column ``out``.

    Columns used: ``votes`` (double), ``seats`` (of the group), ``cap`` (most that a row can get), and ``key``,
    unique in the group, which breaks ties. With V votes and n rows, the divisor V / (seats - n / 2) awards no
    more than ``seats``, so those blocks are in every allotment by highest quotients; at most n are left.
    """
    group = Window.partitionBy(*(within or [F.lit(0)]))
    table = table.withColumn("__v", F.sum("votes").over(group)).withColumn("__n", F.count(F.lit(1)).over(group))
    sure = F.floor(F.col("votes") * (F.col("seats") - F.col("__n") / 2) / F.col("__v") + 0.5)
    table = table.withColumn("__sure", F.when(F.col("__v") > 0, F.least(F.greatest(F.lit(0), sure), F.col("cap"))).otherwise(F.lit(0)))
    table = table.withColumn("__left", F.col("seats") - F.sum("__sure").over(group))
    more = F.when(F.col("__v") > 0, F.least(F.ceil(F.col("votes") * F.col("__n") / F.col("__v")) + 2, F.col("cap") - F.col("__sure"))).otherwise(F.lit(0))
    # a row for each quotient that may win, and one (k = -1) that stays in any case
    each = table.withColumn("__k", F.explode(F.sequence(F.lit(-1).cast("long"), more.cast("long") - 1)))
    quotient = F.when(F.col("__k") >= 0, F.col("votes") / (2 * (F.col("__sure") + F.col("__k")) + 1))
    ranked = group.orderBy(quotient.desc_nulls_last(), F.col(key).asc_nulls_last())
    won = F.when((F.col("__k") >= 0) & (F.row_number().over(ranked) <= F.col("__left")), 1).otherwise(0)
    rest = [c for c in table.columns if c not in (*within, key, "votes", "seats", "cap") and not c.startswith("__")]
    each = each.withColumn("__won", won).groupBy(*within, key).agg(*[F.first(c).alias(c) for c in [*rest, "__sure"]], F.sum("__won").alias("__won"))
    return each.select(*within, key, *rest, (F.col("__sure") + F.col("__won")).cast("long").alias(out))


def source_targets(sums: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """(source, size) to (source, source_size, total, target)."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int") + 1)
    table = sums.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(everything)).withColumn("most", F.col("source_size") * float(max_repeats))
    table = table.withColumn("level", F.col("most") / F.col("weight"))
    rising = everything.orderBy("level", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("share", (F.col("total") - before) / onward)
    share = F.first(F.when(F.col("level") >= F.col("share"), F.col("share")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table.withColumn("target", F.least(F.col("most"), F.col("weight") * share)).select("source", "source_size", "total", "target")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, block_words: int = 16, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target (its source's) and taken: the words that the mix takes."""
    rows = without(docs, "size", "source_size", "target", "taken", "__source", "__bucket", "__order", "__tie")
    rows = rows.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn("__source", F.col(source).cast("string")).withColumn("__bucket", F.pmod(_seeded(F.col(doc_id), seed + 1), F.lit(BUCKETS)))
    buckets = materialize(rows.groupBy(F.col("__source").alias("source"), F.col("__bucket").alias("bucket")).agg(F.sum("size").alias("size")))

    sources = source_targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    blocks = lambda words: F.floor(words * max_repeats / block_words)
    sources = sources.withColumns({"votes": F.col("target"), "seats": F.floor(F.col("total") / block_words + 0.5), "cap": blocks(F.col("source_size"))})
    sources = apportion(sources, [], "source", "quota").withColumn("n_shards", F.least(F.lit(BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    sources = small(materialize(sources.drop("total")))

    shards = buckets.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("source"), F.pmod("bucket", "n_shards").alias("shard")).agg(F.sum("b.size").alias("shard_size"), F.first("quota").alias("seats"))
    shards = shards.withColumns({"votes": F.col("shard_size").cast("double"), "cap": blocks(F.col("shard_size"))})
    shards = small(materialize(apportion(shards, ["source"], "shard", "quota")))
    discard(buckets)

    rows = rows.withColumn("__order", _seeded(F.col(doc_id), seed)).withColumn("__tie", F.xxhash64(text))
    s = sources.select(F.col("source").alias("__s"), "source_size", "target", "n_shards")
    rows = rows.join(s, F.col("__source").eqNullSafe(F.col("__s")), "left").withColumn("__shard", F.pmod("__bucket", "n_shards"))
    h = shards.select(F.col("source").alias("__hs"), F.col("shard").alias("__h"), "shard_size", "quota")
    rows = rows.join(h, F.col("__source").eqNullSafe(F.col("__hs")) & (F.col("__shard") == F.col("__h")), "left")
    stream = Window.partitionBy("__source", "__shard").orderBy("__order", doc_id, "size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    words = F.col("quota") * block_words
    passes, rest = F.floor(words / F.greatest(F.col("shard_size"), F.lit(1))), F.pmod(words, F.greatest(F.col("shard_size"), F.lit(1)))
    taken = F.col("size") * passes + F.greatest(F.lit(0), F.least(rest - F.col("__before"), F.col("size")))
    rows = rows.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))
    names = [c for c in without(docs, "size", "source_size", "target", "taken").columns]
    return rows.select(*[F.col(f"`{c}`") for c in names], "size", "source_size", "target", "taken")
