"""What the operators share: word patterns, shared-folder tables, Arrow batch mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.folders import shared_folder, ship_package

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return the table.

    This cuts lineage: a lost executor costs a re-read, never a recomputation. Columns keep
    their names and types; a table that is only a step can be removed with ``discard``.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tidemark_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    remove(table.sparkSession, table._tidemark_path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """Working tables of an operator whose result is a table of its own."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(materialize(df))
        return self.tables[-1]

    def clear(self) -> None:
        while self.tables:
            discard(self.tables.pop())


def small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Hint a broadcast of an already materialized table if its counted rows are within the bound.

    Beyond the bound the table is returned as it is and joins shuffle it.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names clash (case-insensitively) with those about to be added."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside higher-order functions.

    Without the binding, an outer expression that a lambda mentions is evaluated for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def workers(df: DataFrame) -> DataFrame:
    """``df`` itself, after this package was sent to its session's Python workers."""
    ship_package(df.sparkSession)
    return df


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], added: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Append columns computed per Arrow batch. ``make`` runs once in each task and returns the batch function."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + added)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(columns + work(batch), names=names)

    return workers(df).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    """The strings of a column, a few at a time, so that only a slice exists as Python objects."""
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
