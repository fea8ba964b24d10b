"""Gapless numbers in an order, without one task that sorts all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def number_rows(rows: DataFrame, order: Sequence[str], name: str = "number", start: int = 1, parts: int | None = None) -> DataFrame:
    """Add 1, 2, 3, ... in order. Rows are dealt to tasks by ranges of the order and sorted there; a table of one count a
    task shifts each task's numbers. Ties need enough columns in the order to be told apart.

    The dealt rows are stored: ranges are sampled, so a second evaluation of the plan may deal them in another way.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_task", F.shiftrightunsigned("_id", 33).cast("int"))
    placed = stored(placed)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + start
    return placed.join(F.broadcast(counts), "_task").withColumn(name, place.cast("long")).drop("_id", "_task", "_before")
