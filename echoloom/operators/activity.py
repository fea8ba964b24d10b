"""Activity over time: densest window, tracks by bins, intervals between calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .preprocess import KEY, TIME


def densest_window(chirps: DataFrame, window_ms: int) -> DataFrame:
    """start_ms and n of the closed window [t, t + window_ms], t a chirp's time, with most chirps; the earliest of equals.

    Chirps are counted by time first. A window that begins at an offset into a bucket of one window's length holds its
    bucket's chirps from that offset on and the next bucket's up to the same offset: a running sum over a bucket's offsets,
    window_ms of them at most, so neither the chirps of a recording nor those of a window meet in one task.
    """
    bucket = F.floor(F.col(TIME) / window_ms)
    times = chirps.groupBy(KEY, TIME).agg(F.count("*").alias("_n")).withColumns({"_bucket": bucket, "_offset": F.col(TIME) - bucket * window_ms})
    none = F.lit(0).cast("long")
    own = F.struct(F.col("_bucket").alias("bucket"), F.col("_n").alias("own"), none.alias("next"))
    next_ = F.when(F.col(TIME).isNotNull(), F.struct((F.col("_bucket") - 1).alias("bucket"), none.alias("own"), F.col("_n").alias("next")))
    both = times.select(KEY, "_offset", F.inline(F.array_compact(F.array(own, next_))))
    spots = both.groupBy(KEY, "bucket", "_offset").agg(F.sum("own").alias("own"), F.sum("next").alias("next"))
    whole = Window.partitionBy(KEY, "bucket")
    so_far = whole.orderBy("_offset").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("own").over(whole) + F.col("own") + F.sum(F.col("next") - F.col("own")).over(so_far)
    counted = spots.select(KEY, (F.col("bucket") * window_ms + F.col("_offset")).alias(TIME), "own", n.alias("n")).filter("own > 0")
    best = counted.groupBy(KEY).agg(F.max(F.struct("n", (-F.col(TIME)).alias("t"))).alias("b"))
    return best.select(KEY, (-F.col("b.t")).alias("start_ms"), (F.lit(window_ms) - F.col("b.t")).alias("end_ms"), F.col("b.n").alias("n"))


def densest_window_bucketed(chirps: DataFrame, window_ms: int) -> DataFrame:
    """The same: densest_window() works in buckets."""
    return densest_window(chirps, window_ms)


def bin_width_ms(duration_ms: Column) -> Column:
    """5 s up to 10 minutes, a minute up to 2 hours, else 5 minutes."""
    return F.when(duration_ms <= 600_000, 5_000).when(duration_ms <= 7_200_000, 60_000).otherwise(300_000)


def activity_bins(tracks: DataFrame, width_ms: int, start: str = "start_time_ms", end: str = "end_time_ms", species: str = "species") -> DataFrame:
    """Tracks that overlap each bin (closed at both ends), by species, empty bins included.

    A sweep: a track is one row that adds at its first bin and one that takes away after its last, summed by bin before
    any order, so its cost doesn't grow with its length; what is open in a bin is the running sum over a species' bins.
    """
    spans = tracks.select(species, F.ceil((F.col(start) - width_ms) / width_ms).cast("long").alias("a"), F.floor(F.col(end) / width_ms).cast("long").alias("b"))
    spans = spans.withColumn("a", F.greatest("a", F.lit(0))).filter("a <= b")
    steps = F.array(F.struct(F.col("a").alias("bin"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("bin"), F.lit(-1).alias("step")))
    steps = spans.select(species, F.inline(steps)).groupBy(species, "bin").agg(F.sum("step").alias("step"))
    last = tracks.agg(F.max(F.floor(F.col(end) / width_ms)).alias("b"))
    kinds = tracks.select(species).distinct()
    grid = kinds.withColumn("_last", last.scalar()).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).drop("_last")
    so_far = Window.partitionBy(species).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(steps, [species, "bin"], "left").select(species, "bin", (F.col("bin") * width_ms).alias("bin_start_ms"), F.sum(F.coalesce("step", F.lit(0))).over(so_far).alias("n_tracks"))


def intervals(chirps: DataFrame, track: str = "track_id") -> DataFrame:
    """Positive intervals between the calls of a track."""
    order = Window.partitionBy(track).orderBy(TIME)
    return chirps.withColumn("ici_ms", F.col(TIME) - F.lag(TIME).over(order)).filter("ici_ms > 0")


def visible_tracks(tracks: DataFrame, chirps: DataFrame, low: float, high: float, track: str = "track_id") -> DataFrame:
    """Tracks with a call in [low, high]."""
    return tracks.join(chirps.filter(F.col(TIME).between(low, high)), track, "left_semi")
