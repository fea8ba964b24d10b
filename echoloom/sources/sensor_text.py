"""Sensor logs: a text header, a line DATAASCII, then rows of six whole numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DETECTION, METADATA, struct
from ..scratch import stored

#: Reading rules by flavor: lines skipped after DATAASCII, negatives read, faults raised, header checked and rows by time.
FLAVORS = {"canonical": (0, False, False, False), "web": (2, True, True, False), "strict": (0, False, True, True), "eda": (2, False, False, False)}
#: Names of Spark's part files: those of a folder are one log.
PART = r"^part-\d{5,}-"
KEYS = {"FREQ_KHZ_ENREG": "freq_khz", "LENFFT": "lenfft", "OVERLAP": "overlap", "SNRMIN": "snr_min"}


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, _block, _row, line) of every file, cut by Spark into byte ranges at line breaks of either kind.

    _block orders the ranges of a recording, _row the lines of a range: a task reads a range as one run of rows.
    """
    file = F.col("_metadata.file_path")
    pieces = F.split(file, "/")
    last = F.get(pieces, F.size(pieces) - 1)
    name = F.when(last.rlike(PART), F.get(pieces, F.size(pieces) - 2)).otherwise(last)
    # names of part files get longer when their numbers do
    block = F.struct(F.length(file).alias("a"), file.alias("b"), F.col("_metadata.file_block_start").alias("c"))
    return spark.read.text(path, lineSep="\n").select(name.alias("recording_id"), block.alias("_block"), F.monotonically_increasing_id().alias("_row"), F.regexp_replace("value", "\r$", "").alias("line"))


def _given_lines(spark: SparkSession, text: str, recording_id: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(re.split(r"\r?\n", text))), "_row long, line string")
    return lines.select(F.lit(recording_id).alias("recording_id"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c")).alias("_block"), "_row", "line")


def _blocks(lines: DataFrame, strict: bool) -> DataFrame:
    """One row a range: lines before it in its recording, and its first lines of interest. Stored, as all else starts there."""
    shown = F.trim("line") if strict else F.col("line")
    hits = [F.min(F.when(F.startswith(shown, F.lit(k)), F.struct("_row", shown.alias("text")))).alias(c) for k, c in KEYS.items()]
    ends = [F.min(F.when(line == "DATAASCII", F.col("_row"))).alias(c) for c, line in (("data", F.col("line")), ("data_trimmed", F.trim("line")))]
    found = lines.groupBy("recording_id", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_begin"), F.min_by(F.trim("line"), "_row").alias("first"), *hits, *ends)
    before = Window.partitionBy("recording_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return stored(found).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_begin"))


def _checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.col("recording_id"))).cast("double")).otherwise(value)


def _metadata(blocks: DataFrame, flavor: str) -> DataFrame:
    """One row a recording: METADATA, where its rows begin, and none left out; faults raise when the row is used."""
    strict = flavor in ("web", "strict")
    needed = ["freq_khz", "lenfft", *(["overlap", "snr_min"] if flavor == "strict" else [])]
    word = lambda c: F.get(F.split(F.min(F.when(F.col(c).isNotNull(), F.struct("_block", f"{c}.text")))["text"], r"\s+"), F.lit(1)).try_cast("double")
    found = blocks.groupBy("recording_id").agg(*(word(c).alias(c) for c in KEYS.values()), F.min(F.col("_before") + F.col("data_trimmed" if flavor == "strict" else "data")).alias("data_line"), F.min_by("first", "_block").alias("_first"))
    for column in needed:
        bad = F.col(column).isNull() | ((F.col(column) <= 0) if strict else F.lit(False))
        found = found.withColumn(column, _checked(F.col(column), bad, f"no valid {column} in the header"))
    if strict:
        found = found.withColumn("data_line", _checked(F.col("data_line"), F.col("data_line").isNull(), "no DATAASCII line").cast("long"))
    if flavor == "strict":
        found = found.withColumn("freq_khz", _checked(F.col("freq_khz"), F.col("_first") != "DETECTDATA", "the first line is not DETECTDATA"))
    return found.withColumn("bin_khz", F.col("freq_khz") / F.col("lenfft")).drop("_first")


def _read(lines: DataFrame, flavor: str) -> tuple[DataFrame, DataFrame]:
    skip, negative, counted, ordered = FLAVORS[flavor]
    blocks = _blocks(lines, flavor in ("web", "strict"))
    meta = _metadata(blocks, flavor)
    sign = "-?" if negative else ""
    kept = lines.filter(F.col("line").rlike(rf"^\s*{sign}\d+(\s+{sign}\d+){{5}}\s*$"))
    # a row a range and a row a recording: far fewer than lines
    kept = kept.join(F.broadcast(blocks.select("recording_id", "_block", "_before")), ["recording_id", "_block"]).withColumn("line_no", F.col("_before") + F.col("_row"))
    kept = kept.join(meta.select("recording_id", "data_line"), "recording_id").filter(F.col("line_no") > F.col("data_line") + skip)
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    fields = struct(DETECTION).fields[2:8]
    rows = kept.select("recording_id", F.col("line_no").cast("long").alias("line_no"), *(F.get(words, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))
    if counted:
        counts = rows.groupBy("recording_id").agg(F.count("*").alias("_n"))
        meta = meta.join(counts, "recording_id", "left").withColumn("bin_khz", _checked(F.col("bin_khz"), F.col("_n").isNull(), "no data rows")).drop("_n")
    return (rows.orderBy("recording_id", "time_ms", "line_no") if ordered else rows), meta.select(*(f.name for f in struct(METADATA).fields))


def read_sensor_text(spark: SparkSession, path: str, flavor: str = "canonical") -> tuple[DataFrame, DataFrame]:
    """(detections, metadata) of one log, a folder or a pattern. A file is a recording named as it is; the
    part files of a folder, in their order, are one log named as the folder, as write_sensor_text leaves it.

    canonical keeps lines of exactly six unsigned whole numbers after DATAASCII and drops others. web skips two more
    lines, keeps negatives and raises on faulty headers; strict checks the header and orders by time; eda skips two more
    lines. In web and strict a log without rows raises when its metadata are used.

    A file of any size is read by many tasks, by byte ranges. A first pass counts each range's lines and finds header
    lines in it (a row a range, stored), from which line numbers and metadata follow; the second reads rows.
    """
    return _read(_split_lines(spark, path), flavor)


def parse_sensor_text(spark: SparkSession, text: str, flavor: str = "canonical", recording_id: str = "text") -> DataFrame:
    """Detections of a log held in memory; faults of its header raise here."""
    rows, meta = _read(_given_lines(spark, text, recording_id), flavor)
    meta.collect()
    return rows
