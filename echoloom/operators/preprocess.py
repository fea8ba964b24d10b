"""Cleaning of detections: artefacts, passages, echoes, social calls, counters. DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import bins_to_khz
from ..schema import BUCKET_MS, PreprocessConfig
from ..scratch import stored

KEY, TIME, TIE = "recording_id", "time_ms", "line_no"


def add_khz(rows: DataFrame, bin_khz: Column | float) -> DataFrame:
    return rows.withColumns({f"{c}_khz": bins_to_khz(F.col(f"pos_{c}"), bin_khz) for c in ("fme", "fi", "ft")})


def is_artefact() -> Column:
    return (F.col("pos_fme") == 0) & (F.col("snr_db") == 0) & (F.col("duration_windows") == 0)


def drop_artefacts(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_artefact())


def in_band(value: Column, low: float, high: float) -> Column:
    """Open at both ends."""
    return (value > low) & (value < high)


def _bucketed(rows: DataFrame, bucket_ms: int | None) -> tuple[DataFrame, list[str]]:
    """rows with the keys that they are dealt to tasks by: recording and bucket of time, or whole recordings for None."""
    if bucket_ms is None:
        return rows, [KEY]
    return rows.withColumn("_bucket", F.floor(F.col(TIME) / bucket_ms)), [KEY, "_bucket"]


def mark_steps(rows: DataFrame, gap_ms: float, columns: Sequence[str] = (), gap: str = "gap_ms", passage: str = "passage_id", number: str | None = None, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Add, in order of time, then line: the gap to the row before (null on a recording's first), the passage (a new one,
    from 1, where the gap reaches gap_ms), prev_<column> of the row before and, if named, the row's number from 0.

    A recording is cut into buckets of time. Rows are dealt and ordered by (recording, bucket); what lies before a bucket
    comes from a table of one row for each bucket that has rows, made from the few columns that it needs, so a recording
    of any length is spread over tasks and its rows are shuffled once. Without buckets a recording is ordered in one task.
    """
    parted, keys = _bucketed(rows, bucket_ms)
    order = Window.partitionBy(*keys).orderBy(TIME, TIE)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    parted = parted.withColumns({f"prev_{c}": F.lag(c).over(order) for c in (TIME, *columns)})
    opens = (F.col(TIME) - F.col(f"prev_{TIME}")) >= gap_ms
    if bucket_ms is None:
        parted = parted.withColumn(gap, F.col(TIME) - F.col(f"prev_{TIME}"))
        parted = parted.withColumn(passage, F.sum(F.coalesce(opens, F.lit(True)).cast("long")).over(so_far))
        parted = parted if number is None else parted.withColumn(number, F.row_number().over(order).cast("long") - 1)
        return parted.drop(f"prev_{TIME}")
    parted = parted.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("long"))
    place = F.struct(TIME, TIE)
    ends = parted.groupBy(*keys).agg(F.min(TIME).alias("_start"), F.max(TIME).alias("_end"), F.sum("_opens").alias("_inside"), F.count("*").alias("_rows"), *(F.max_by(c, place).alias(f"_last_{c}") for c in columns))
    across = Window.partitionBy(KEY).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.lag("_end").over(across))
    ends = ends.withColumn("_first", F.coalesce(F.col("_start") - F.col("_before") >= gap_ms, F.lit(True)).cast("long"))
    ends = ends.select(
        *keys, "_before", *(F.lag(f"_last_{c}").over(across).alias(f"_before_{c}") for c in columns),
        (F.coalesce(F.sum(F.col("_first") + F.col("_inside")).over(earlier), F.lit(0)) + F.col("_first")).alias("_passages"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_numbers"),
    )
    first = F.col(f"prev_{TIME}").isNull()
    parted = parted.withColumn(passage, F.sum("_opens").over(so_far))
    parted = parted if number is None else parted.withColumn(number, F.row_number().over(order).cast("long") - 1)
    parted = parted.join(ends, keys)
    filled = {gap: F.col(TIME) - F.when(first, F.col("_before")).otherwise(F.col(f"prev_{TIME}")), passage: F.col(passage) + F.col("_passages")}
    filled |= {f"prev_{c}": F.when(first, F.col(f"_before_{c}")).otherwise(F.col(f"prev_{c}")) for c in columns}
    filled |= {} if number is None else {number: F.col(number) + F.col("_numbers")}
    return parted.withColumns(filled).drop("_bucket", "_opens", "_before", "_passages", "_numbers", f"prev_{TIME}", *(f"_before_{c}" for c in columns))


def running_count(rows: DataFrame, flag: Column, name: str, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Add how often the flag held up to and with this row. Rows cut into buckets are stored first, as they are read twice."""
    parted, keys = _bucketed(rows.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long")), bucket_ms)
    parted = parted if bucket_ms is None else stored(parted)
    order = Window.partitionBy(*keys).orderBy(TIME, TIE).rowsBetween(Window.unboundedPreceding, 0)
    counted = parted.withColumn(name, F.sum("_flag").over(order))
    if bucket_ms is None:
        return counted.drop("_flag")
    before = Window.partitionBy(KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy(*keys).agg(F.sum("_flag").alias("_total")).select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return counted.join(totals, keys).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_flag", "_before")


def sessionize(rows: DataFrame, gap_ms: float, gap: str = "gap_ms", passage: str = "passage_id", bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Add the gap to the row before (null on the first) and the passage: a new one, from 1, where the gap reaches gap_ms."""
    return mark_steps(rows, gap_ms, gap=gap, passage=passage, bucket_ms=bucket_ms)


def mark_gaps(rows: DataFrame, gap_ms: float, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """sessionize(), and delta_fme_bins: the distance to the row before, across passages, echoes included."""
    rows = mark_steps(rows, gap_ms, ["pos_fme"], bucket_ms=bucket_ms)
    return rows.withColumn("delta_fme_bins", F.abs(F.col("pos_fme") - F.col("prev_pos_fme"))).drop("prev_pos_fme")


def flag_echoes(rows: DataFrame, config: PreprocessConfig) -> DataFrame:
    """Add is_echo. A row is linked to the one before when near in time and frequency.

    drop_later: every linked row is an echo. best_snr: of each chain of links the strongest row, the first of equals,
    stays, and the others are echoes.
    """
    link = F.coalesce((F.col("gap_ms") <= config.echo_gap_ms) & (F.col("delta_fme_bins") <= config.echo_bins), F.lit(False))
    if config.strategy == "drop_later":
        return rows.withColumn("is_echo", link)
    rows = running_count(rows, ~link, "_chain", config.bucket_ms)
    best = Window.partitionBy(KEY, "_chain").orderBy(F.desc("snr_db"), TIME, TIE)
    return rows.withColumn("is_echo", F.row_number().over(best) > 1).drop("_chain")


@dataclass
class Preprocessed:
    """Lazy tables of one run: flagged (all rows but artefacts, echoes flagged), clean (echoes and social calls gone, with
    passages numbered before the frequency filter), counters (one row a recording)."""

    flagged: DataFrame
    clean: DataFrame
    counters: DataFrame


def preprocess(rows: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> Preprocessed:
    """Clean detections. Nothing runs until a table is used, but for the stored steps of a recording cut into buckets."""
    kept = drop_artefacts(add_khz(rows, config.bin_khz))
    flagged = flag_echoes(mark_gaps(kept, config.passage_gap_ms, config.bucket_ms), config)
    flagged = stored(flagged) if config.bucket_ms else flagged
    no_echo = sessionize(flagged.filter(~F.col("is_echo")), config.passage_gap_ms, "gap_ms2", "passage_id2", config.bucket_ms)
    clean = no_echo.filter(F.col("fme_khz") > config.fme_min_khz)
    if config.min_passage_chirps > 1:
        size = F.count("*").over(Window.partitionBy(KEY, "passage_id2"))
        clean = clean.withColumn("_size", size).filter(F.col("_size") >= config.min_passage_chirps).drop("_size")
    return Preprocessed(flagged, clean, counters(rows, no_echo, flagged, config))


def counters(rows: DataFrame, no_echo: DataFrame, flagged: DataFrame, config: PreprocessConfig) -> DataFrame:
    """Counters of the stages, one row a recording: three aggregations, each combined before its shuffle."""
    social = F.col("fme_khz") <= config.fme_min_khz
    raw = rows.groupBy(KEY).agg(F.count("*").alias("n_raw"), F.count_if(is_artefact()).alias("n_artefacts"))
    marked = flagged.groupBy(KEY).agg(F.count("*").alias("n_clean"), F.count_if("is_echo").alias("n_echoes"), F.max("passage_id").alias("n_sequences"))
    sizes = no_echo.groupBy(KEY, "passage_id2").agg(F.count("*").alias("n"), F.count_if(social).alias("s"))
    after = sizes.groupBy(KEY).agg(
        F.sum("n").alias("n_no_echo"), F.sum("s").alias("n_social"), F.count("*").alias("n_sequences_no_echo"), F.count_if(F.col("n") - F.col("s") >= max(1, config.min_passage_chirps)).alias("n_passages_detected")
    )
    found = raw.join(marked, KEY, "left").join(after, KEY, "left").na.fill(0)
    return found.withColumn("n_filtered", F.col("n_no_echo") - F.col("n_social"))


def passages(clean: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """One row a passage: first and last time, rows and median frequency."""
    found = clean.groupBy(KEY, F.col("passage_id2").alias("passage_id")).agg(F.min(TIME).alias("start_ms"), F.max(TIME).alias("end_ms"), F.count("*").alias("n_chirps"), F.median("fme_khz").alias("fme_median_khz"))
    return found.filter(F.col("n_chirps") >= config.min_passage_chirps)


#: What a chirp of a nested passage holds after its time and line, by the name of its column in `clean`.
CHIRP = {c: c for c in ("pos_fme", "pos_fi", "pos_ft", "duration_windows", "snr_db", "fme_khz", "fi_khz", "ft_khz")} | {"gap_ms2": "gap_ms", "delta_fme_bins": "delta_fme_bins"}


def nested_passages(clean: DataFrame, bucket_ms: int | None = None) -> DataFrame:
    """Passages with their chirps in order, as an array of structs of the fields that clean has.

    With buckets, a passage is one such row for each bucket of time (part) that has chirps of it, with first and last time
    and number of these: parts in order hold the passage's chirps in order, and no task or row holds a long passage whole,
    which a row of Spark, 2 GB at most, could not from some 19 million chirps on.
    """
    parted, keys = _bucketed(clean.withColumn("passage_id", F.col("passage_id2")), bucket_ms)
    chirp = F.struct(TIME, TIE, *(F.col(c).alias(name) for c, name in CHIRP.items() if c in clean.columns))
    nested = parted.groupBy(*keys, "passage_id").agg(F.min(TIME).alias("start_ms"), F.max(TIME).alias("end_ms"), F.count("*").alias("n_chirps"), F.sort_array(F.collect_list(chirp)).alias("chirps"))
    return nested.withColumnRenamed("_bucket", "part")


def passage_lines(clean: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Nested passages with their chirps' line numbers in order, as one text: parts are nested by tasks of a bucket of time
    each and hand on their texts, so the task of a passage reads no more than what it returns."""
    parts = nested_passages(clean, bucket_ms).withColumn("lines", F.array_join(F.transform("chirps", lambda c: c[TIE].cast("string")), ","))
    found = parts.groupBy(KEY, "passage_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_chirps").alias("n_chirps"), F.sort_array(F.collect_list(F.struct("part", "lines"))).alias("parts")
    )
    return found.select(KEY, "passage_id", "start_ms", "end_ms", "n_chirps", F.array_join("parts.lines", ",").alias("lines"))


def segments(rows: DataFrame, gap_ms: float, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Half-open row ranges [row_start, row_end) of the sequences of a store, by its own order."""
    rows = mark_steps(rows.select(KEY, TIME, TIE), gap_ms, number="_row", bucket_ms=bucket_ms)
    return rows.groupBy(KEY, F.col("passage_id").alias("segment")).agg(F.min("_row").alias("row_start"), (F.max("_row") + 1).alias("row_end"), F.count("*").alias("n"))
