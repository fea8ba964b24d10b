"""Passages of a stream of detections, by recording, across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.preprocess import KEY, TIE, TIME, sessionize
from ..schema import BUCKET_MS, DETECTION

OUT = f"{DETECTION}, gap_ms long, passage_id long, late boolean"
STATE = "last_ms long, passage_id long"


def stream_passages(rows: DataFrame, gap_ms: float) -> DataFrame:
    """Each detection with its gap and passage, numbered as by sessionize() where detections of a recording arrive in
    order of time. One from before the last seen is passed on as late, without a passage, and changes nothing.

    A session window can't say this: it merges a gap of exactly its length, where a passage ends. One task holds a
    recording's rows of a micro-batch, so a source with a backlog needs a limit a trigger; passage_writer() needs none.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["time_ms", "line_no"], kind="stable")
        last, passage = state.get if state.exists else (None, 0)
        late = rows["time_ms"] < last if last is not None else pd.Series(False, index=rows.index)
        good = rows[~late].copy()
        before = good["time_ms"].shift()
        if last is not None and len(good):
            before.iloc[0] = last
        gap = good["time_ms"] - before
        good["gap_ms"] = gap.astype("Int64")
        good["passage_id"] = passage + (gap.isna() | (gap >= gap_ms)).cumsum()
        good["late"] = False
        if len(good):
            state.update((int(good["time_ms"].iloc[-1]), int(good["passage_id"].iloc[-1])))
        if len(good):
            yield good
        if late.any():
            none = pd.Series(pd.NA, index=rows.index[late], dtype="Int64")
            yield rows[late].assign(gap_ms=none, passage_id=none, late=True)

    return rows.groupBy("recording_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


LAST = "recording_id string, last_ms long, last_passage long"


def passage_writer(rows: DataFrame, gap_ms: float, folder: str, bucket_ms: int = BUCKET_MS) -> DataStreamWriter:
    """A writer of what stream_passages() says, for micro-batches and recordings of any size: read_passages() reads it back.

    A micro-batch is numbered by sessionize(), which deals a recording to tasks by buckets of time. Each recording's last
    call so far, a row of the table that the batch before has left, goes before its new calls and carries gap and number
    on. Both tables are written by batch, so a batch that is repeated after a failure replaces its own.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        if number == 0:
            before = spark.createDataFrame([], LAST)
            found = sessionize(batch, gap_ms, bucket_ms=bucket_ms).withColumn("late", F.lit(False))
        else:
            before = spark.read.schema(LAST).parquet(f"{folder}/last/batch={number - 1}")
            seen = batch.withColumn("_new", F.lit(True)).join(before, KEY, "left")
            late = F.coalesce(F.col(TIME) < F.col("last_ms"), F.lit(False))
            carried = before.withColumns({TIME: F.col("last_ms"), TIE: F.lit(None).cast("long"), "_new": F.lit(False)})  # a null line comes first
            found = sessionize(seen.filter(~late).unionByName(carried, allowMissingColumns=True), gap_ms, bucket_ms=bucket_ms).filter("_new")
            found = found.withColumns({"passage_id": F.col("passage_id") + F.coalesce(F.col("last_passage") - 1, F.lit(0)), "late": F.lit(False)})
            found = found.unionByName(seen.filter(late).withColumn("late", F.lit(True)), allowMissingColumns=True)
        found.select(*names, "gap_ms", "passage_id", "late").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        new = spark.read.schema(OUT).parquet(f"{folder}/rows/batch={number}").filter("not late").groupBy(KEY).agg(F.max(TIME).alias("last_ms"), F.max("passage_id").alias("last_passage"))
        both = before.unionByName(new).groupBy(KEY).agg(F.max("last_ms").alias("last_ms"), F.max("last_passage").alias("last_passage"))
        both.write.mode("overwrite").parquet(f"{folder}/last/batch={number}")

    return rows.writeStream.foreachBatch(step)


def read_passages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(f"{folder}/rows/batch=*")
