"""Resolution of a change log (k, seq, typ, v): the latest version of a key wins and a deletion hides it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALUE, DELETION = 1, 0


def normalise(log: DataFrame) -> DataFrame:
    """An empty or missing value is a deletion."""
    empty = F.coalesce(F.length("v"), F.lit(0)) == 0
    return log.withColumn("typ", F.when(empty, DELETION).otherwise(F.col("typ"))).withColumn("v", F.when(empty | (F.col("typ") == DELETION), None).otherwise(F.col("v")))


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key, deletions included. Filters on ``k`` pass through to the scan."""
    newest = Window.partitionBy("k").orderBy(F.col("seq").desc())
    return log.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def live(log: DataFrame) -> DataFrame:
    """What a scan shows: the newest versions that are values. The filter must stay above ``latest``."""
    return latest(log).where(F.col("typ") == VALUE)


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The scan as it was after the write numbered ``seq``."""
    return live(log.where(F.col("seq") <= seq))


def versions(log: DataFrame) -> DataFrame:
    """Every version, by key, newest first."""
    return log.orderBy("k", F.col("seq").desc())


def overwritten(log: DataFrame) -> DataFrame:
    """k, v and n_versions of live keys. Counting needs every version, so both come from one aggregate."""
    newest = F.max_by(F.struct("typ", "v"), "seq")
    return log.groupBy("k").agg(newest.alias("x"), F.count(F.lit(1)).alias("n_versions")).where(F.col("x.typ") == VALUE).select("k", F.col("x.v").alias("v"), "n_versions")


def restored(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a value that follows a deletion."""
    order = Window.partitionBy("k").orderBy("seq")
    marked = log.withColumn("before", F.lag("typ").over(order)).withColumn("after", F.lead("seq").over(order))
    return marked.where("after is null and typ = 1 and before = 0").select("k", "seq", "v")
