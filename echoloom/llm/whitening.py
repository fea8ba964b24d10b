"""Whitening of embeddings: RowMatrix over exactly centred rows, local eigenvectors, projections in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch, map_arrow, table

#: Components that are returned at most, and the whole numbers that entries become.
COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: A component whose share of the variance is no more than this holds rounding errors only.
NOTHING = 1e-14
#: Largest size of a whole number: an entry beyond it becomes that.
BOUND = 2.0**52


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, floor(1024 c) + 100000 of each entry c, in longs.

    Vectors that are null or hold null or non-finite entries are left out; null vec_ids and repeated rows stay. An entry
    beyond 2^52 in size after scaling counts as that. Further columns are ignored.
    """
    x = F.transform(column, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-BOUND)), F.lit(BOUND)).cast("long") + SHIFT)
    rows = vectors.filter(F.col(column).isNotNull() & ~F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _padded(lists: list[np.ndarray], width: int) -> np.ndarray:
    """Lists as rows of one width; what a shorter one lacks is an entry of zero."""
    out = np.full((len(lists), width), SHIFT, np.int64)
    for row, values in zip(out, lists):
        row[: len(values)] = values
    return out


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task: rows, and the sum of x - 100000 at each place, in Python's integers."""
    rows, sums, high = 0, np.zeros(0, object), 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            lists = [np.asarray(x, np.int64) for x in batch.slice(start, 1024).column("x").to_pylist()]
            width = max(map(len, lists), default=0)
            x = _padded(lists, width) - SHIFT
            high = max(high, int(np.abs(x).max(initial=0)))
            part = x.sum(0).astype(object)  # 1024 times 2^52 is within 64 bits
            if width > len(sums):
                sums = np.concatenate([sums, np.zeros(width - len(sums), object)])
            sums[:width] += part
            rows += len(lists)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([high], pa.int64())], ["n", "sums", "high"])


def moments(rows: DataFrame) -> tuple[int, list[int], int]:
    """Count of rows, exact sums of x at each place, and the largest |x - 100000|. A task hands on one row."""
    parts = Scratch(rows.sparkSession).save(map_arrow(rows.select("x"), _task_sums, "n long, sums array<string>, high long"), "sums")
    n, high = parts.agg(F.sum("n"), F.max("high")).first()
    if not n:
        return 0, [], 0
    at = parts.select(F.posexplode("sums").alias("place", "sum")).groupBy("place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    sums = [int(r["sum"]) + n * SHIFT for r in at.orderBy("place").collect()]  # a number for each dimension
    return n, sums, high


def fits(n: int, high: int) -> bool:
    """Whether n times any x - 100000, less its sum, is within 64 bits."""
    return 2 * (high + 1) * n < 2**62


def centred(rows: DataFrame, n: int, sums: list[int], small: bool) -> DataFrame:
    """x - S / n of each row as a vector column: the whole number n * x - S, rounded once, over n.

    Whole numbers are longs where they fit, else decimals.
    """
    kind = "long" if small else "decimal(38,0)"
    low = F.array(*(F.lit(str(s - n * SHIFT)).cast("decimal(38,0)").cast(kind) for s in sums))
    full = F.concat(F.transform("x", lambda c: c - SHIFT), F.array_repeat(F.lit(0).cast("long"), F.lit(len(sums)) - F.size("x")))
    steps = F.zip_with(full, low, lambda c, s: (c.cast(kind) * F.lit(n).cast("long") - s).cast("double") / F.lit(float(n)))
    return rows.select(array_to_vector(steps).alias("v"))


def covariance(vectors: DataFrame, n: int) -> np.ndarray:
    """Gramian of a column of centred vectors, summed up in a tree over the tasks, over n."""
    rows = MLUtils.convertVectorColumnsFromML(vectors, "v")
    gram = RowMatrix(rows).computeGramianMatrix()
    return gram.toArray() / n


def components(cov: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those without variance are left out.

    Of either sign, that with the largest entry positive is taken.
    """
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    kept = values > NOTHING * max(np.trace(cov), 0.0)
    values, vectors = values[kept], vectors[:, kept]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[top, np.arange(len(values))])


def _whiten(sent, n: int, small: bool):
    """Rows to whitened coordinates and exact deviations, a chunk of rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weights = sent.value
        below = np.array([s - n * SHIFT for s in sums], np.int64 if small else object)
        for frame in frames:
            for start in range(0, len(frame), 1024):
                part = frame.iloc[start : start + 1024]
                x = _padded([np.asarray(v, np.int64) for v in part["x"]], len(sums)) - SHIFT
                steps = x * n - below if small else x.astype(object) * n - below
                if small and int(np.abs(steps).max(initial=0)) ** 2 * len(sums) < 2**63:
                    deviation = (steps * steps).sum(1)
                else:
                    deviation = np.array([min(sum(int(s) ** 2 for s in row), 2**63 - 1) for row in steps], np.int64)
                white = (steps.astype(float) / n) @ weights
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "deviation": deviation, "white": list(white)})

    return run


_WHITE = "vec_id long, deviation long, white array<double>"


def whiten(rows: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component from 1, n, deviation, whitened, explained and identity_error, a row for each row and component.

    rows as whole_numbers() gives. deviation is the exact sum of (n x - S)^2 over dimensions (the largest long where it is
    beyond one). identity_error is measured: the covariance of the stored whitened rows, centred again, against the identity. Vectors
    shorter than the longest end in entries of zero. Components without variance are left out, so rows that are all alike,
    an empty table and vectors without entries give no rows.

    Only sums, the covariance and the projection go through the driver: of d dimensions, d^2 numbers, however many rows.
    Three passes over the vectors (sums, Gramian, projection), none with a shuffle of rows; projections are written
    once, 8 numbers a row, and their own covariance comes from a second small Gramian.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    ship(spark)
    n, sums, high = moments(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not sums:
        return spark.createDataFrame([], schema)
    small = fits(n, high)
    cov = covariance(centred(rows, n, sums, small), n)
    values, vectors = components(cov, count)
    if not len(values):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((sums, vectors / np.sqrt(values)))
    white = scratch.save(rows.mapInPandas(_whiten(sent, n, small), _WHITE), "white")
    means = [r["m"] for r in white.select(F.posexplode("white").alias("place", "c")).groupBy("place").agg(F.avg("c").alias("m")).orderBy("place").collect()]
    again = white.select(array_to_vector(F.zip_with("white", F.array(*map(F.lit, means)), lambda c, m: c - m)).alias("v"))
    error = float(np.abs(covariance(again, n) - np.eye(len(values))).max())
    shares = F.array(*(F.lit(float(v)) for v in values / np.trace(cov)))
    found = white.select("vec_id", "deviation", F.posexplode("white").alias("place", "whitened"))
    return found.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_numbers(table(spark, sf_dir, "embeddings")))
