"""Joins of points to intervals, as equal joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Levels of doubled buckets at most: 2^40 buckets of any width.
LEVELS = 40


def _nodes(first: Column, end: Column) -> Column:
    """The dyadic blocks (level, node) that together cover the buckets from first to end - 1, two a level at most.

    Node k of level j holds the buckets from k 2^j to (k + 1) 2^j - 1. Of the whole nodes between the ends, a level lists
    the first if it is odd and the last if it is even; all others are halves of nodes one level up.
    """

    def at(j: Column) -> Column:
        left, right = -F.floor(-first / F.pow(F.lit(2.0), j)).cast("long"), F.floor(end / F.pow(F.lit(2.0), j)).cast("long")
        begins = F.when((left < right) & (F.pmod(left, F.lit(2)) == 1), F.struct(j.cast("int").alias("level"), left.alias("node")))
        ends = F.when((left < right) & (F.pmod(right, F.lit(2)) == 1), F.struct(j.cast("int").alias("level"), (right - 1).alias("node")))
        return F.array_compact(F.array(begins, ends))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(end - first + 1)).cast("int"))), at))


def points_in_intervals(points: DataFrame, time: str, intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """points joined to the closed intervals that hold their time.

    Time is cut into buckets of `width`. An interval is listed under the few dyadic blocks of buckets that cover it (one
    or two for a short one, the logarithm of its length for any), a point under its block on each level that the longest
    interval needs. They meet in exactly one block, so the join is on equal blocks, with a test for the ends. Intervals that
    end before they start hold no point.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spans = intervals.filter(F.col(start) <= F.col(end))
    listed = spans.withColumn("_block", F.explode(_nodes(bucket(start), bucket(end) + 1)))
    top = spans.agg(F.max(F.least(F.lit(LEVELS), F.ceil(F.log2(bucket(end) - bucket(start) + 2)))).cast("int").alias("top"))
    levels = F.sequence(F.lit(0), F.coalesce(top.scalar(), F.lit(0)))
    placed = points.withColumn("_level", F.explode(levels)).withColumn("_block_of", F.struct(F.col("_level").alias("level"), F.floor(F.floor(F.col(time) / width) / F.pow(F.lit(2.0), F.col("_level"))).cast("long").alias("node")))
    inside = (F.col("_block_of") == F.col("_block")) & F.col(time).between(F.col(start), F.col(end))
    return placed.join(listed, inside).drop("_level", "_block_of", "_block")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals that meet."""
    return (a_start <= b_end) & (a_end >= b_start)
