"""Point, multi-key, ordered and range reads over a change log (k, seq, typ, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.resolve import DELETION, latest, live

OK, MISSING, DELETED = "OK", "NotFound", "NotFound: deleted"


def get(log: DataFrame, key: str) -> DataFrame:
    return live(log.where(F.col("k") == key)).select("k", "v")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """A row (k, status, v) for each requested key. The keys reach the log before it is resolved."""
    wanted = keys.select("k").distinct()
    found = latest(log.join(wanted, "k", "left_semi")).select(F.col("k").alias("fk"), "typ", "v")
    status = F.when(F.col("typ").isNull(), MISSING).when(F.col("typ") == DELETION, DELETED).otherwise(OK)
    return wanted.join(found, F.col("k") == F.col("fk"), "left").select("k", status.alias("status"), F.when(status == OK, F.col("v")).alias("v"))


def contains(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("k").distinct().join(live(log).select("k"), "k", "left_semi")


def seek(log: DataFrame, target: str) -> DataFrame:
    """The first live key at or after ``target``."""
    return live(log.where(F.col("k") >= target)).select("k", "v").orderBy("k").limit(1)


def seek_scan(log: DataFrame, target: str, n: int) -> DataFrame:
    """``n`` live keys from ``target`` on."""
    return live(log.where(F.col("k") >= target)).select("k", "v").orderBy("k").limit(n)


def range_scan(log: DataFrame, begin: str, end: str) -> DataFrame:
    return live(log.where((F.col("k") >= begin) & (F.col("k") < end))).select("k", "v").orderBy("k")


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    return live(log.where(F.col("k").startswith(prefix))).select("k", "v").orderBy("k")
