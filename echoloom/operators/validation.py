"""Counting accuracy: scenarios from truth, assignment of tracks, errors, grouped summaries, bootstrap intervals."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import parse_parameter
from ..scratch import stored
from .ranges import points_in_intervals

#: Resamples, share outside the interval, first seed.
SAMPLES, ALPHA, SEED = 1000, 0.05, 20260511
#: Shares of Poisson draws of mean 1 that are below 1, 2, 3, ...
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(10))
MARGIN_MS = 20


def scenarios_from_truth(truth: DataFrame) -> DataFrame:
    """One window a scenario, 20 ms wider on both sides than its individuals; its other columns are the first individual's."""
    first = {c: F.min_by(c, F.struct("start_ms", "individual_id")).alias(c) for c in ("dataset", "case_type", "replicate_id", "expected_count", "notes")}
    found = truth.groupBy("scenario_id").agg(*first.values(), (F.min("start_ms") - MARGIN_MS).alias("_from"), (F.max("end_ms") + MARGIN_MS).alias("_to"))
    found = found.withColumn("_p", parse_parameter(F.col("notes")))
    return found.select("dataset", "scenario_id", "case_type", "replicate_id", F.col("_from").alias("start_ms"), F.col("_to").alias("end_ms"), "expected_count", F.col("_p.name").alias("parameter_name"), F.col("_p.value").alias("parameter_value"))


def match_counts(calls: DataFrame, scenarios: DataFrame, width: int = 10_000) -> DataFrame:
    """Calls of each track inside each scenario: (track_id, scenario_id, case_type, scenario_start, matched)."""
    windows = scenarios.select("scenario_id", "case_type", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    met = points_in_intervals(calls.select("track_id", "time_ms"), "time_ms", windows, "_s", "_e", width)
    return met.groupBy("track_id", "scenario_id", "case_type", F.col("_s").alias("scenario_start")).agg(F.count("*").alias("matched"))


def assign_tracks(tracks: DataFrame, calls: DataFrame, scenarios: DataFrame, width: int = 10_000) -> DataFrame:
    """Each track's scenario of most calls, the earliest of equals; status by majority and rivals; UNASSIGNED without any."""
    counts = match_counts(calls, scenarios, width)
    order = Window.partitionBy("track_id").orderBy(F.desc("matched"), "scenario_start", "scenario_id")
    rivals = F.count("*").over(Window.partitionBy("track_id"))
    best = counts.withColumns({"_place": F.row_number().over(order), "_rivals": rivals}).filter("_place = 1").drop("_place", "scenario_start")
    found = tracks.select("track_id", "n_chirps", "start_time_ms", "end_time_ms", "passage_species").join(best, "track_id", "left")
    status = F.when(F.col("matched").isNull(), "unassigned_false_positive").when(F.col("matched") < F.ceil(F.col("n_chirps") / 2), "ambiguous_no_majority").when(F.col("_rivals") > 1, "ambiguous_majority").otherwise("assigned")
    return found.select(
        "track_id", F.coalesce("scenario_id", F.lit("UNASSIGNED")).alias("scenario_id"), F.coalesce("case_type", F.lit("false_positive")).alias("case_type"), "n_chirps",
        F.coalesce("matched", F.lit(0)).cast("int").alias("matched_chirps"), status.alias("assignment_status"), "start_time_ms", "end_time_ms", "passage_species",
    )


def scenario_metrics(scenarios: DataFrame, assignments: DataFrame) -> DataFrame:
    """Detected against expected individuals of every scenario, none detected included."""
    counts = assignments.filter("scenario_id <> 'UNASSIGNED'").groupBy("scenario_id").agg(F.count("*").alias("detected_count"))
    rows = scenarios.join(counts, "scenario_id", "left").withColumn("detected_count", F.coalesce("detected_count", F.lit(0)).cast("int"))
    rows = rows.withColumn("signed_error", F.col("detected_count") - F.col("expected_count"))
    return rows.select(
        "dataset", "scenario_id", "case_type", "replicate_id", "start_ms", "parameter_name", "parameter_value", "expected_count", "detected_count", "signed_error", F.abs("signed_error").alias("absolute_error"),
        (F.col("signed_error") * F.col("signed_error")).alias("squared_error"), (F.col("signed_error") == 0).alias("exact_match"), (F.col("signed_error") < 0).alias("undercount"), (F.col("signed_error") > 0).alias("overcount"),
    )


def grouped_errors(metrics: DataFrame) -> DataFrame:
    """Errors of all scenarios and of each case, in one pass over grouping sets; group_id 1 is the total."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c.removesuffix('_match')}_rate")
    case = F.col("case_type")
    found = metrics.groupingSets([[], [case]], case).agg(
        F.grouping_id().cast("int").alias("group_id"), F.count("*").alias("n_scenarios"), F.avg("signed_error").alias("bias_mean"), F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"),
        share("exact_match"), share("undercount"), share("overcount"),
    )
    name = F.when(F.col("group_id") == 1, "global").otherwise(case).alias("group")
    return found.select(name, "group_id", "n_scenarios", "bias_mean", "mae", "rmse", "exact_rate", "undercount_rate", "overcount_rate")


def bootstrap_interval(values: np.ndarray, statistic: Callable = np.mean, seed: int = SEED, samples: int = SAMPLES, alpha: float = ALPHA) -> tuple[float, float]:
    """Percentile interval of a statistic over resamples with replacement; NaN without values."""
    if not len(values):
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    found = [float(statistic(values[rng.integers(0, len(values), len(values))])) for _ in range(samples)]
    low, high = np.quantile(found, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def bootstrap_table(metrics: DataFrame, seed: int = SEED, samples: int = SAMPLES) -> DataFrame:
    """Intervals of bias, mean absolute error and exact rate for all scenarios and each case: seeds s, s + 1, s + 2.

    A scenario counts in a resample as often as a Poisson draw of mean 1 says, which a hash of its id, the resample and
    the seed decides. So weights and weighted errors are sums by (group, resample), combined before their shuffle, no task
    holds a group, and a table read in any order gives the same intervals.
    """
    case, total = F.struct(F.lit(0).alias("group_id"), F.col("case_type").alias("group")), F.struct(F.lit(1).alias("group_id"), F.lit("global").alias("group"))
    rows = metrics.select("scenario_id", "case_type", "signed_error", "absolute_error", F.col("exact_match").cast("int").alias("exact"))
    rows = rows.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    columns = {"bias": "signed_error", "mae": "absolute_error", "exact": "exact"}
    for k, name in enumerate(columns):
        hashed = F.md5(F.concat_ws(":", "scenario_id", F.col("resample").cast("string"), F.lit(str(seed + k))))
        u = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / float(1 << 52)
        weight = F.lit(len(POISSON))
        for n, limit in reversed(list(enumerate(POISSON))):
            weight = F.when(u < limit, n).otherwise(weight)
        rows = rows.withColumn(f"w_{name}", weight)
    cases = rows.groupBy("case_type", "resample").agg(*(F.sum(f"w_{n}").alias(f"w_{n}") for n in columns), *(F.sum(F.col(f"w_{n}") * F.col(c)).alias(f"s_{n}") for n, c in columns.items()))
    both = cases.withColumn("g", F.explode(F.array(total, case))).groupBy("g", "resample").agg(*(F.sum(f"{p}_{n}").alias(f"{p}_{n}") for p in "ws" for n in columns))
    means = both.select("g", *((F.col(f"s_{n}").cast("double") / F.nullif(F.col(f"w_{n}"), F.lit(0))).alias(n) for n in columns))
    ends = [F.percentile(n, F.lit(q)).alias(f"{n}_ci_{e}") for n in columns for e, q in (("low", ALPHA / 2), ("high", 1 - ALPHA / 2))]
    return means.groupBy("g").agg(*ends).select("g.group_id", "g.group", *(f"{n}_ci_{e}" for n in columns for e in ("low", "high")))


def summarize(metrics: DataFrame, seed: int = SEED, samples: int = SAMPLES) -> DataFrame:
    """Errors with intervals, the total first, then cases by name."""
    return grouped_errors(metrics).join(bootstrap_table(metrics, seed, samples), ["group_id", "group"]).orderBy(F.desc("group_id"), "group")


def sweep_curve(metrics: DataFrame) -> DataFrame:
    """Mean absolute error and exact rate by parameter value of each sweep."""
    rows = metrics.filter(F.col("parameter_value").isNotNull() & ~F.isnan("parameter_value"))
    return rows.groupBy("case_type", "parameter_value").agg(F.avg("absolute_error").alias("mae"), F.avg(F.col("exact_match").cast("double")).alias("exact_rate"), F.count("*").alias("n"))


def error_histogram(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("signed_error").agg(F.count("*").alias("n"))


def bar_groups(summary: DataFrame) -> DataFrame:
    """Cases that a bar chart shows: no total, no sweep."""
    return summary.filter((F.col("group") != "global") & ~F.endswith(F.col("group"), F.lit("_sweep")))


def evaluate(rows: DataFrame, truth: DataFrame, module: str | Callable | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, summary, assignments) of detections against their truth. The tracker never sees the truth."""
    from ..schema import PreprocessConfig
    from .counting import count_individuals, tracker
    from .preprocess import preprocess

    scenarios = scenarios_from_truth(truth)
    clean = preprocess(rows, PreprocessConfig(strategy="best_snr")).clean
    counted = count_individuals(clean) if module is None else tracker(module)(clean)
    ids = counted.tracks.select("recording_id", "passage_id", "packet", "open_ord", "track_id")
    calls = counted.calls.join(ids, ["recording_id", "passage_id", "packet", "open_ord"])
    assignments = stored(assign_tracks(counted.tracks, calls, scenarios))  # a row a track, used by three tables
    metrics = stored(scenario_metrics(scenarios, assignments))
    return metrics, summarize(metrics, seed), assignments


def profile(rows: DataFrame, truth: DataFrame) -> dict[str, float]:
    """Seconds of an evaluation, and what 1000 scenarios would take."""
    n_rows, n = rows.count(), truth.select("scenario_id").distinct().count()
    began = time.perf_counter()
    evaluate(rows, truth)[1].collect()
    spent = time.perf_counter() - began
    return {"n_scenarios": n, "n_rows": n_rows, "evaluation_sec": spent, "sec_per_scenario": spent / max(1, n), "estimated_1000_scenarios_sec": 1000 * spent / max(1, n)}
