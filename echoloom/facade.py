"""Whole runs over files: what the command line calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import activity, counting, eda, mixtures, validation
from .operators.preprocess import Preprocessed, preprocess, sessionize
from .operators.species import label, predict
from .schema import MixtureConfig, PreprocessConfig, SplitConfig, TrackingConfig
from .sinks import files
from .sources.sensor_text import read_sensor_text
from .sources.tables import read_truth_csv


def load(spark: SparkSession, path: str, flavor: str = "canonical") -> tuple[DataFrame, float]:
    """Detections of a log and the width of its bins; logs of one call share it."""
    rows, meta = read_sensor_text(spark, path, flavor)
    widths = {r["bin_khz"] for r in meta.select("bin_khz").distinct().limit(2).collect()}
    if len(widths) != 1:
        raise ValueError("the logs have no common width of frequency bins")
    return rows, widths.pop()


def preprocess_file(spark: SparkSession, path: str, config: PreprocessConfig = PreprocessConfig(), flavor: str = "canonical") -> Preprocessed:
    rows, width = load(spark, path, flavor)
    return preprocess(rows, replace(config, bin_khz=width))


def cluster_file(spark: SparkSession, path: str, config: PreprocessConfig = PreprocessConfig(), mixture: MixtureConfig = MixtureConfig(), flavor: str = "canonical") -> tuple[str, DataFrame]:
    """(report, histogram feed) of one recording's species mixture."""
    rows, width = load(spark, path, flavor)
    done = preprocess(rows, replace(config, bin_khz=width))
    model = mixtures.fit_models(done.clean, [mixture]).first()
    if model is None:
        raise ValueError("at least two detections are needed for a mixture")
    labels = done.clean.select("fme_khz", predict(F.col("fme_khz"), model["means"], model["sigmas"], model["weights"]).alias("label"))
    counts = {r["label"]: r for r in labels.groupBy("label").agg(F.count("*").alias("n"), F.median("fme_khz").alias("median")).withColumn("species", label(F.col("median"))).collect()}
    clusters = []
    for k in range(model["k"]):
        row = counts.get(k)
        clusters.append({"label": k, "n": row["n"] if row else 0, "median": row["median"] if row else None, "species": row["species"] if row else "Indetermine", "mean": model["means"][k], "sigma": model["sigmas"][k], "weight": model["weights"][k]})
    limits = done.clean.agg(F.min("fme_khz").alias("a"), F.max("fme_khz").alias("b")).first()
    feed = eda.histogram(done.clean, F.col("fme_khz"), limits["a"], max(limits["b"], limits["a"] + 1e-6), 80, density=True)
    settings = [
        ("log", path), ("kHz a bin", width), ("passage gap ms", config.passage_gap_ms), ("echo rule", config.strategy), ("echo gap ms", config.echo_gap_ms), ("echo bins", config.echo_bins), ("least kHz", config.fme_min_khz),
        ("components from", f"peaks of a density, bandwidth {mixture.bandwidth} times {mixture.scale}, prominence {mixture.prominence}, {mixture.max_components} at most"),
        ("starts", f"{mixture.n_init} with seed {mixture.seed}; number {model['start']} is the likeliest, log-likelihood {model['log_likelihood']:.3f}"),
    ]
    return files.clustering_report(settings, done.counters.first().asDict(), clusters, model["thresholds"], model["peaks"]), feed


def count_file(spark: SparkSession, path: str, config: PreprocessConfig | None = None, split: SplitConfig = SplitConfig(), tracking: TrackingConfig = TrackingConfig()) -> counting.Counted:
    config = config or PreprocessConfig(strategy="best_snr", min_passage_chirps=3)
    return counting.count_individuals(preprocess_file(spark, path, config).clean, split, tracking)


def activity_feeds(counted: counting.Counted, zoom_ms: int = 30_000) -> dict[str, DataFrame]:
    """What a chart of tracks shows: activity by species, the densest window and its tracks, intervals."""
    keys = ["recording_id", "passage_id", "packet", "open_ord"]
    calls = counted.calls.join(counted.tracks.select(*keys, "track_id"), keys)
    span = counted.tracks.agg(F.max("end_time_ms").alias("e"), F.min("start_time_ms").alias("s"), F.percentile("ici_median_ms", F.lit(1.0)).alias("i")).first()
    length = (span["e"] or 0) - (span["s"] or 0)
    width = 5_000 if length <= 600_000 else 60_000 if length <= 7_200_000 else 300_000
    top = min(max(span["i"] or 180.0, 180.0), 250.0)
    intervals = activity.intervals(calls)
    return {
        "activity": activity.activity_bins(counted.tracks.withColumnRenamed("passage_species", "species"), width), "densest": activity.densest_window(calls, zoom_ms),
        "intervals": intervals, "interval_histogram": eda.histogram(intervals, F.col("ici_ms"), 0.0, top, 35),
    }


def summarize_zone(spark: SparkSession, path: str, low: float = 22.0, high: float = 28.0, gap_ms: float = 100.0) -> str:
    rows, width = load(spark, path)
    found = preprocess(rows, PreprocessConfig(passage_gap_ms=gap_ms, bin_khz=width)).flagged
    zone = eda.zone_summary(found, low, high).first().asDict()
    inside = found.filter((F.col("fme_khz") > low) & (F.col("fme_khz") < high))
    largest = eda.top_sequences(inside, 10)
    keys = ["recording_id", "passage_id"]
    middles = inside.join(F.broadcast(largest.select(*keys)), keys).groupBy(*keys).agg(F.median("fme_khz").alias("fme_median"), F.median("snr_db").alias("snr_median"))
    top = [r.asDict() for r in largest.join(middles, keys).orderBy(F.desc("n"), F.desc("passage_id")).collect()]
    return files.zone_report(path, low, high, found.count(), zone, top)


def eda_feeds(rows: DataFrame, gap_ms: float = 100.0) -> dict[str, DataFrame]:
    """Tables of an exploratory look: frequencies by group, gaps, sequences, stability, shapes, signal."""
    flagged = preprocess(rows, PreprocessConfig(passage_gap_ms=gap_ms)).flagged
    fme, gap = F.col("fme_khz"), F.col("gap_ms")
    sizes = eda.durations(flagged)
    return {
        "fme": eda.histogram(flagged, fme, 0.0, 100.0, 100, density=True), "fme_low": eda.histogram(flagged.filter((fme > 18) & (fme <= 48)), fme, 18.0, 48.0, 60), "fme_high": eda.histogram(flagged.filter(fme > 48), fme, 48.0, 100.0, 60),
        "gaps_100": eda.histogram(flagged.filter(gap <= 100), gap, 0.0, 100.0, 50), "gaps_500": eda.histogram(flagged.filter(gap <= 500), gap, 0.0, 500.0, 50), "gap_stats": eda.gap_stats(flagged), "sizes": eda.sequence_sizes(flagged),
        "size_histogram": eda.histogram(sizes, F.least("n", F.lit(50)), 0.0, 50.0, 50), "durations": eda.histogram(sizes.filter("n >= 2"), F.least("duration_ms", F.lit(2000)), 0.0, 2000.0, 50), "stability": eda.fme_stability(flagged),
        "shape": eda.correlations(flagged), "snr": eda.histogram(flagged, F.col("snr_db"), 0.0, 60.0, 60), "fme_over_time": flagged.select((F.col("time_ms") / 3_600_000).alias("hours"), fme, "snr_db"),
        "echo_distance": flagged.groupBy(F.least("delta_fme_bins", F.lit(20)).alias("bins"), "is_echo").agg(F.count("*").alias("n")),
    }


def evaluate_files(spark: SparkSession, log: str, truth: str, folder: str, dataset: str = "dev", module: str | Callable | None = None, seed: int = validation.SEED, charts: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, summary and assignments of a log against its truth, written as CSV, and the tables that charts show."""
    rows, _ = load(spark, log)
    metrics, summary, assignments = validation.evaluate(rows, read_truth_csv(spark, truth), module, seed)
    files.write_evaluation(metrics, summary, assignments, folder, dataset)
    if charts:
        feeds = {"bars": validation.bar_groups(summary), "scatter": metrics.select("case_type", "expected_count", "detected_count"), "sweeps": validation.sweep_curve(metrics), "errors": validation.error_histogram(metrics)}
        for name, table in feeds.items():
            table.write.mode("overwrite").option("header", True).csv(f"{charts}/{dataset}_{name}")
    return metrics, summary, assignments


def imported_clips(spark: SparkSession, path: str, store_id: str, gap_ms: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(clips, rows of the store) of a log imported into a project."""
    from .operators.preprocess import add_khz, segments
    from .operators.clips import import_as_clips

    rows, width = load(spark, path, "strict")
    sized = sessionize(add_khz(rows, width), gap_ms)
    return import_as_clips(eda.clip_summary(sized), segments(rows, gap_ms), store_id), rows
