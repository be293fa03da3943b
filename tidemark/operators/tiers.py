"""Tiers of a change log: memory tables, flushed runs, levels, blocks and where a read is answered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import TRAILER_BYTES, varint_length
from tidemark.operators.resolve import latest

MEM, IMM = -2, -1
#: A block takes entries until the next one would pass this many bytes; every so many entries it restarts.
BLOCK_BYTES, RESTART = 4096, 16


def with_run(log: DataFrame, batch: int) -> DataFrame:
    return log.withColumn("run", F.floor(F.col("seq") / batch).cast("long"))


def level_of(run: Column, newest: int) -> Column:
    """The newest run is in memory, the next is being flushed, the four before are level 0, older ones level 1."""
    age = F.lit(newest) - run
    return F.when(age == 0, MEM).when(age == 1, IMM).when(age <= 5, 0).otherwise(1)


def with_tiers(log: DataFrame, batch: int, newest: int) -> DataFrame:
    runs = with_run(log, batch)
    return runs.withColumn("level", level_of(F.col("run"), newest))


def entry_bytes(k: Column, v: Column) -> Column:
    """Bytes of a block entry: shared length, key length, stored key, value length, value."""
    klen = F.octet_length(k) + TRAILER_BYTES
    vlen = F.coalesce(F.octet_length(v), F.lit(0))
    return (F.lit(1) + varint_length(klen) + klen + varint_length(vlen) + vlen).cast("long")


def payload_bytes(k: Column, v: Column) -> Column:
    return (F.octet_length(k) + TRAILER_BYTES + F.coalesce(F.octet_length(v), F.lit(0))).cast("long")


def rotation(log: DataFrame, buffer_bytes: int, batch: int) -> DataFrame:
    """seq and mem_id: the memory table that a write goes to when tables rotate at ``buffer_bytes`` of payload.

    Sums run within batches of writes and are shifted by the sums of earlier batches, so no task holds the log.
    """
    sized = with_run(log, batch).withColumn("bytes", payload_bytes(F.col("k"), F.col("v")))
    sums = sized.groupBy("run").agg(F.sum("bytes").alias("run_bytes"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("run", F.coalesce(F.sum("run_bytes").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(inside), F.lit(0)) + F.col("shift")
    return sized.join(shifts, "run").select("seq", F.floor(before / buffer_bytes).cast("long").alias("mem_id"))


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run").agg(
        F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("typ") == 0, 1).otherwise(0)).cast("long").alias("tombstones"), F.sum(payload_bytes(F.col("k"), F.col("v"))).cast("long").alias("bytes"),
    )


def manifest(tiers: DataFrame) -> DataFrame:
    """level, run, first_key, last_key of flushed runs."""
    flushed = tiers.where("level >= 0")
    return flushed.groupBy("level", "run").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"))


def read_tier(tiers: DataFrame) -> DataFrame:
    """k and level of the tier that answers a read of k."""
    return latest(tiers).select("k", F.col("level").cast("int").alias("tier"))


def block_index(runs: DataFrame) -> DataFrame:
    """run, block_no, n, last_key: entries in key order packed greedily into blocks.

    Where a block starts depends on all before it in its run, which no window expresses; a run is bounded by the
    size of a memory table, so it is packed in one task.
    """
    sized = runs.select("run", "k", "seq", entry_bytes(F.col("k"), F.col("v")).alias("bytes"))

    def pack(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values(["k", "seq"], ascending=[True, False], kind="stable")
        block, filled, numbers = 0, 0, []
        for size in run["bytes"].tolist():
            if filled and filled + size > BLOCK_BYTES:
                block, filled = block + 1, 0
            filled += size
            numbers.append(block)
        out = run.assign(block_no=numbers).groupby("block_no", as_index=False).agg(n=("k", "size"), last_key=("k", "last"))
        return out.assign(run=run["run"].iloc[0])[["run", "block_no", "n", "last_key"]]

    return sized.groupBy("run").applyInPandas(pack, "run long, block_no long, n long, last_key string")


def restart_points(runs: DataFrame) -> DataFrame:
    """run, seq and pos of the entries at which key compression would restart."""
    order = Window.partitionBy("run").orderBy("k", F.col("seq").desc())
    at = runs.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    return at.where(F.col("pos") % RESTART == 0).select("run", "seq", "pos")


def candidates(keys: DataFrame, bounds: DataFrame) -> DataFrame:
    """k and run: runs whose key range holds k. Bounds are a manifest.

    A range stands under each first byte that its keys may have, 256 at most, so keys and ranges meet in an equi-join; Spark
    broadcasts the bounds where it knows them to be small.
    """
    byte = lambda c: F.coalesce(F.conv(F.substring(F.hex(F.col(c).cast("binary")), 1, 2), 16, 10).cast("int"), F.lit(-1))
    spread = bounds.withColumn("byte", F.explode(F.sequence(byte("first_key"), byte("last_key"))))
    hit = (F.col("k") >= F.col("first_key")) & (F.col("k") <= F.col("last_key"))
    return keys.withColumn("byte", byte("k")).join(spread, "byte").where(hit).select("k", "run")
