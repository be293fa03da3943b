"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

The statistics of a text (see ``quality``) become bounded features, standardised over all documents. Random
cosine features approximate a Gaussian kernel over them. Each partition sums its share of the normal equations
of the labelled rows and the shares are added by position, so what reaches the driver is one matrix of fixed size; the ridge solution is
a weight for each cosine. For the calibration each labelled row is scored by the solution without its fold, which needs no further
pass, as the sums are kept by fold; rows with equal features share a fold. Those scores are counted in ``BINS`` bins, and
pooling adjacent violators over the bins gives the calibration, with straight lines between the blocks so that ties
are few.

Labels are taken only from rows whose crc32(doc_id as text) mod 3 is not 1. All of them are used; there is no
sample. Neither doc_id nor lang, source or labels are inputs of a score.

Defined cases: null and empty texts are scored by their statistics, which are 0; very long texts are read whole; equal
texts get equal scores; further columns are ignored, whatever their names; a null doc_id has no label and is not
held out; of several labels for a document each counts; null labels are ignored; without labels every score is
0.5, and with one class it is that class; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Steps, map_batches, materialize, workers
from tidemark.llm.quality import STATS, with_stats

COSINES = 192
BINS = 2000
RIDGE = 1e-3
FOLDS = 4


def features() -> dict[str, Column]:
    share = lambda part, of: F.least(F.col(part) / F.greatest(F.col(of), F.lit(1)), F.lit(4.0))
    return {
        "f_length": F.log1p("n_words"),
        "f_word": F.least(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(20.0)),
        "f_symbols": share("n_symbols", "n_words"),
        "f_duplicates": share("n_dup_lines", "n_lines"),
        "f_repeats": share("n_repeat_words", "n_words"),
        "f_distinct": share("n_distinct_words", "n_words"),
        "f_upper": share("n_upper", "n_letters"),
        "f_marks": share("n_marks", "n_words"),
        "f_letters": share("n_letters", "word_chars"),
        "f_lines": share("n_lines", "n_words"),
    }


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])


def pool(n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: first bin, last bin and mean of each block. ``n`` rows, ``y`` their sum."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(n):
        blocks.append([i, i, float(n[i]), float(y[i])])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, m, s = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + m, blocks[-1][3] + s]
    out = np.array(blocks).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 3] / np.maximum(out[:, 2], 1)


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", seed: int = 7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, a table in the shared folder."""
    step = Steps()
    names = list(features())
    rows = with_stats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    rows = rows.withColumns(features()).drop(*STATS)
    rows = rows.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False)))
    rows = step(rows)
    total = rows.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)]).first()
    centre = np.array([total[f"m{i}"] or 0.0 for i in range(len(names))])
    scale = np.array([max(total[f"s{i}"] or 0.0, 1e-9) for i in range(len(names))])
    rng = np.random.default_rng(seed)
    slopes = rng.normal(0, 1, (len(names), COSINES)) / np.sqrt(len(names) / 2)
    phases = rng.uniform(0, 2 * np.pi, COSINES)

    def cosines(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - centre) / scale, -6, 6)
        return np.column_stack([np.cos(z @ slopes + phases) * np.sqrt(2 / COSINES), np.ones(len(x))])

    known = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y")).where("y is not null")
    train = step(rows.where("not held_out").join(known, "doc_id").select(*names, "y", F.pmod(F.xxhash64(*names), F.lit(FOLDS)).cast("int").alias("fold")))
    size = COSINES + 2
    at = np.triu_indices(size)

    def normal(batches):
        sums = np.zeros((FOLDS, size, size))
        for batch in batches:
            z = np.column_stack([cosines(_matrix(batch, names)), batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)])
            folds = batch.column(batch.schema.get_field_index("fold")).to_numpy()
            for fold in np.unique(folds):
                own = z[folds == fold]
                sums[fold] += own.T @ own
        for fold in np.flatnonzero(sums.any(axis=(1, 2))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), fold), pa.int32()), pa.array(at[0] * size + at[1], pa.int32()), pa.array(sums[fold][at])], names=["fold", "at", "x"])

    parts = workers(train).mapInArrow(normal, "fold int, at int, x double").groupBy("fold", "at").agg(F.sum("x").alias("x")).toArrow()
    sums = np.zeros((FOLDS, size * size))
    sums[parts["fold"].to_numpy(), parts["at"].to_numpy()] = parts["x"].to_numpy()
    sums = sums.reshape(FOLDS, size, size)

    def solved(upper: np.ndarray) -> np.ndarray:
        whole = upper + np.triu(upper, 1).T
        n = whole[size - 2, size - 2]
        return np.linalg.solve(whole[:-1, :-1] + np.eye(size - 1) * (RIDGE * n + 1e-9), whole[:-1, -1]) if n else np.r_[np.zeros(COSINES), 0.5]

    weights = solved(sums.sum(axis=0))
    without_fold = np.column_stack([solved(sums.sum(axis=0) - sums[f]) for f in range(FOLDS)])

    def bin_of(raw: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1)

    def raw_scores():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            folds = batch.column(batch.schema.get_field_index("fold")).to_numpy()
            raw = (cosines(_matrix(batch, names)) @ without_fold)[np.arange(len(folds)), folds]
            return [pa.array(bin_of(raw).astype(np.int64))]

        return work

    counted = map_batches(train, raw_scores, [T.StructField("bin", T.LongType())], ["y"]).groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("y")).collect()
    seen, got = np.zeros(BINS), np.zeros(BINS)
    for row in counted:
        seen[row["bin"]], got[row["bin"]] = row["n"], row["y"]
    first, last, mean = pool(seen, got)
    knots = np.column_stack([first + 0.25, last + 0.75]).ravel() if len(mean) else np.array([0.0])
    levels = np.repeat(mean, 2) if len(mean) else np.array([0.5])
    tilt = 1e-4  # keeps the order of raw scores inside a block

    def final():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            raw = cosines(_matrix(batch, names)) @ weights
            place = (raw + 0.5) / 2 * BINS
            calibrated = np.interp(place, knots, levels)
            return [pa.array(np.clip((1 - tilt) * calibrated + tilt / (1 + np.exp(-np.clip(4 * (raw - 0.5), -50, 50))), 0, 1))]

        return work

    out = map_batches(rows, final, [T.StructField("score", T.DoubleType())], ["doc_id", "held_out"])
    out = materialize(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
    step.clear()
    return out
