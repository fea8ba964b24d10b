"""Exploratory figures as tables: gaps, sequences, stability, shapes, zones, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .preprocess import KEY, TIME, TIE, in_band
from .quantiles import quantiles


def _with_quantiles(figures: DataFrame, rows: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """A row of figures with exact quantiles of the rows."""
    return figures.withColumns({name: F.lit(value).cast("double") for name, value in quantiles(rows, wanted).items()})


def gap_stats(rows: DataFrame, short: float = 10, long: float = 100) -> DataFrame:
    """Median, mean and linear 95th percentile of gaps, shares within two limits and the count beyond."""
    gap = F.col("gap_ms")
    rows = rows.filter(gap.isNotNull())
    figures = rows.agg(F.avg(gap).alias("mean_gap"), F.avg((gap <= short).cast("double")).alias("share_short"), F.avg((gap <= long).cast("double")).alias("share_long"), F.count_if(gap > long).alias("n_beyond"))
    found = _with_quantiles(figures, rows, {"median_gap": (gap, 0.5), "p95_gap": (gap, 0.95)})
    return found.select("median_gap", "mean_gap", "p95_gap", "share_short", "share_long", "n_beyond")


def sequence_sizes(rows: DataFrame, passage: str = "passage_id") -> DataFrame:
    sizes = stored(rows.groupBy(KEY, passage).agg(F.count("*").alias("n")))
    found = _with_quantiles(sizes.agg(F.count("*").alias("n_sequences"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size")), sizes, {"median_size": (F.col("n"), 0.5)})
    return found.select("n_sequences", "median_size", "mean_size", "max_size")


def fme_stability(rows: DataFrame, passage: str = "passage_id") -> DataFrame:
    """Of sequences of two or more: how many, and median and mean of their sample deviation of frequency."""
    each = stored(rows.groupBy(KEY, passage).agg(F.count("*").alias("n"), F.stddev_samp("fme_khz").alias("sd")).filter("n >= 2"))
    return _with_quantiles(each.agg(F.count("*").alias("n_sequences"), F.avg("sd").alias("mean_sd")), each, {"median_sd": (F.col("sd"), 0.5)}).select("n_sequences", "median_sd", "mean_sd")


def correlations(rows: DataFrame) -> DataFrame:
    return rows.agg(F.corr("fme_khz", "ft_khz").alias("fme_ft"), F.corr("fme_khz", "fi_khz").alias("fme_fi"))


def durations(rows: DataFrame, passage: str = "passage_id") -> DataFrame:
    return rows.groupBy(KEY, passage).agg((F.max(TIME) - F.min(TIME)).alias("duration_ms"), F.count("*").alias("n"))


def zone_summary(rows: DataFrame, low: float, high: float, passage: str = "passage_id") -> DataFrame:
    """Rows of an open band: count, share, quantiles of frequency and signal, time span, sequences and their sizes."""
    zone = rows.filter(in_band(F.col("fme_khz"), low, high))
    whole = rows.agg(F.count("*").alias("_all"))
    sizes = stored(zone.groupBy(KEY, passage).agg(F.count("*").alias("n")))
    per = sizes.agg(F.count("*").alias("n_sequences"), F.max("n").alias("max_per_sequence"))
    stats = zone.agg(F.count("*").alias("n"), F.min(TIME).alias("first_ms"), F.max(TIME).alias("last_ms"))
    shares = (("median", 0.5), ("q10", 0.1), ("q90", 0.9))
    stats = _with_quantiles(stats, zone, {f"{name}_{figure}": (F.col(column), q) for name, column in (("fme", "fme_khz"), ("snr", "snr_db")) for figure, q in shares})
    stats = _with_quantiles(stats, sizes, {"median_per_sequence": (F.col("n"), 0.5)})
    one = lambda df, c: df.select(c).scalar()
    stats = stats.withColumns({"share": F.col("n") / one(whole, "_all"), **{c: one(per, c) for c in ("n_sequences", "max_per_sequence")}})
    return stats.select(
        "n", "fme_median", "fme_q10", "fme_q90", "snr_median", "snr_q10", "snr_q90", "first_ms", "last_ms", "share", "n_sequences", "median_per_sequence", "max_per_sequence"
    )


def top_sequences(rows: DataFrame, n: int = 10, passage: str = "passage_id") -> DataFrame:
    """The n largest sequences; of equal ones those of the larger id."""
    sizes = rows.groupBy(KEY, passage).agg(F.count("*").alias("n"), F.min(TIME).alias("start_ms"), F.max(TIME).alias("end_ms"))
    return sizes.orderBy(F.desc("n"), F.desc(passage), KEY).limit(n)


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """Equal bins of [low, high]; values outside count in the edge bins. Empty bins have rows too."""
    width = (high - low) / bins
    place = F.least(F.greatest(F.floor((value - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.filter(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    found = every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = found.withColumn("bin_start", F.lit(float(low)) + F.col("bin") * F.lit(width))
    if density:
        found = found.withColumn("density", F.col("n") / (F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)) * F.lit(width)))
    return found


def clip_summary(rows: DataFrame, segment: str = "passage_id") -> DataFrame:
    """Of each imported segment: times, median frequency, its sample deviation (0 for one row), median interval (0), median
    signal, rows, species by the ranges of imports."""
    from .species import COMMON_RULES, label

    order = Window.partitionBy(KEY, segment).orderBy(TIME, TIE)
    rows = rows.withColumn("_ici", F.col(TIME) - F.lag(TIME).over(order))
    found = rows.groupBy(KEY, segment).agg(
        F.min(TIME).alias("first_ms"), F.max(TIME).alias("last_ms"), F.median("fme_khz").alias("fme_median_khz"), F.coalesce(F.stddev_samp("fme_khz"), F.lit(0.0)).alias("fme_std_khz"),
        F.coalesce(F.median("_ici"), F.lit(0.0)).alias("ici_median_ms"), F.median("snr_db").alias("snr_median_db"), F.count("*").alias("n_detections"),
    )
    return found.withColumn("species", label(F.col("fme_median_khz"), COMMON_RULES, None))
