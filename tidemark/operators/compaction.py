"""Merge of runs, compaction and what it does to the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.resolve import VALUE, latest
from tidemark.sources.folders import written

TRIGGER = 4


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """All versions of several runs in key order, newest first."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.orderBy("k", F.col("seq").desc())


def compact(inputs: DataFrame, *, bottom: bool = True) -> DataFrame:
    """The newest versions of the inputs. Deletions go only if no older run lies below (``bottom``)."""
    newest = latest(inputs)
    return newest.where(F.col("typ") == VALUE) if bottom else newest


def compact_range(log: DataFrame, begin: str, end: str) -> DataFrame:
    """Compaction of the keys in [begin, end); others keep all their versions."""
    inside = (F.col("k") >= begin) & (F.col("k") < end)
    return compact(log.where(inside)).unionByName(log.where(~inside))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank0, the place of k among all keys, and total.

    Keys are dealt by bounds that Spark samples, so parts are of like size whatever the keys have in common. The parts are
    written once, as another sample would deal them otherwise; the running sums over their counts, a number for each
    part, shift the ranks that are made within each part, so that no task sorts all keys.
    """
    keyed = written(rows.repartitionByRange("k").withColumn("p", F.spark_partition_id()))
    counts = keyed.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("p", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("shift"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("p").orderBy("k")
    return keyed.join(shifts, "p").withColumn("rank0", F.row_number().over(inside) - 1 + F.col("shift")).drop("p", "shift")


def outputs(compacted: DataFrame, n_files: int) -> DataFrame:
    """file, first_key, last_key, n of a compaction's output cut into ``n_files`` key ranges of equal counts
    (the first ones hold one more if they don't divide)."""
    size, more = F.floor(F.col("total") / n_files), F.col("total") % n_files
    big = more * (size + 1)
    file = F.when(F.col("rank0") < big, F.floor(F.col("rank0") / (size + 1))).otherwise(more + F.floor((F.col("rank0") - big) / F.greatest(size, F.lit(1))))
    cut = ranked(compacted).withColumn("file", file.cast("long"))
    return cut.groupBy("file").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count(F.lit(1)).alias("n"))


def need(tiers: DataFrame) -> DataFrame:
    """level, n (runs) and flag: whether level 0 has reached the trigger."""
    runs = tiers.where("level >= 0").groupBy("level").agg(F.countDistinct("run").alias("n"))
    return runs.select(F.col("level").cast("int").alias("level"), "n", ((F.col("level") == 0) & (F.col("n") >= TRIGGER)).alias("flag"))


def overlapping(bounds: DataFrame) -> DataFrame:
    """run_a < run_b: pairs of runs whose key ranges meet. Bounds are a manifest, a row for each run."""
    a = bounds.select(F.col("run").alias("run_a"), F.col("first_key").alias("fa"), F.col("last_key").alias("la"))
    b = bounds.select(F.col("run").alias("run_b"), F.col("first_key").alias("fb"), F.col("last_key").alias("lb"))
    return a.join(b, (F.col("run_a") < F.col("run_b")) & (F.col("la") >= F.col("fb")) & (F.col("lb") >= F.col("fa"))).select("run_a", "run_b")


def after_compaction(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The manifest without the input runs and with the output files."""
    return manifest.join(removed.select("run"), "run", "left_anti").select("level", "run", "first_key", "last_key").unionByName(added.select("level", "run", "first_key", "last_key"))
