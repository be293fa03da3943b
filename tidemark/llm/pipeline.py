"""Stages of the corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns its columns with their own names, types and
values; a column that has the name of one that an operator adds comes through unchanged. Only line dedup changes values,
those of text and n_chars. Mixing, the last, adds size, source_size, target and taken and replaces such columns.

Defined cases: null and empty texts and texts of less than ten words go with the quality rules; repeated rows are judged
alike, line dedup leaves them alike and mixing takes each; rows that share a doc_id count as one document for
near-duplicates; rows with a null doc_id are never near-duplicates; very long texts are read whole; an n_chars column may
be missing; an empty table passes as an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, mixing, oracles, quality, sketch
from tidemark.llm.common import WORD, remove, table
from tidemark.sources.folders import shared_folder


def carried(docs: DataFrame, used: set[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose columns, but those used, have names that clash with nothing; names come back after."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in used}
    out = work(docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return carried(docs, {"text"}, lambda d: quality.judge(d).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, and with them documents that have no word left; n_chars follows."""
    out = carried(docs, {"doc_id", "text"}, lambda d: lines.dedup_lines(d).where(F.col("text").rlike(WORD)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return carried(docs, {"doc_id", "text"}, sketch.drop_near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    items = table(spark, sf_dir, "benchmark")
    return carried(docs, {"text"}, lambda d: decontaminate.find_contamination(d, items).where("not contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with the number of words that it takes."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: The same rows by SQL: every stage's query inside the next.
ORACLE_SQL = oracles.pipeline()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again, and goes when the next is there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
