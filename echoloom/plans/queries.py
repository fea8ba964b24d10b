"""Queries of the detection operators over the `events` table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units
from ..operators import activity, clips as clip_tables, counting, density, eda, mixtures, validation
from ..operators import preprocess as pre
from ..operators.ranges import overlaps, points_in_intervals
from ..operators.species import BANDS, COMMON_RULES, LATIN_RULES, SPECIES_NAMES, band, label, label_sql, posterior, predict
from ..schema import CLIP, MixtureConfig, PreprocessConfig, SplitConfig
from ..scratch import scratch_folder as scratch
from .events_view import BUCKET, ECHO, GAP, detections, with_steps
from .model_sql import density_sql, tracker_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(call: Query) -> Query:
        QUERIES[name] = call
        if sql:
            ORACLE_SQL[name] = sql
        return call

    return add


def config(**changes) -> PreprocessConfig:
    return PreprocessConfig(**({"passage_gap_ms": GAP, "echo_gap_ms": ECHO, "bucket_ms": BUCKET} | changes))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre.drop_artefacts(pre.add_khz(detections(spark, sf_dir), 0.390625))


def passaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre.sessionize(kept(spark, sf_dir), GAP, bucket_ms=BUCKET)


def cleaned(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    return pre.preprocess(detections(spark, sf_dir), config(**changes)).clean


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def shown(c: str):
    """Whole numbers that may be null, -1 for none: tables compared across engines keep a whole-number type."""
    return F.coalesce(F.col(c), F.lit(-1)).alias(c)


@query("freq_projection", with_steps("SELECT line_no, fme_khz, fi_khz, ft_khz FROM khz", "khz"))
def freq_projection(spark, sf_dir):
    return pre.add_khz(detections(spark, sf_dir), 0.390625).select("line_no", "fme_khz", "fi_khz", "ft_khz")


@query("artefact_filter", with_steps("SELECT line_no, time_ms, pos_fme, snr_db FROM art", "art"))
def artefact_filter(spark, sf_dir):
    return pre.drop_artefacts(detections(spark, sf_dir)).select("line_no", "time_ms", "pos_fme", "snr_db")


@query("social_filter", with_steps("SELECT line_no, fme_khz FROM art WHERE fme_khz > 18", "art"))
def social_filter(spark, sf_dir):
    return kept(spark, sf_dir).filter("fme_khz > 18").select("line_no", "fme_khz")


@query("gap_lag", with_steps("SELECT line_no, coalesce(gap_ms, -1) AS gap_ms, coalesce(delta_fme_bins, -1) AS delta_fme_bins FROM gaps", "gaps"))
def gap_lag(spark, sf_dir):
    return pre.mark_gaps(kept(spark, sf_dir), GAP, BUCKET).select("line_no", shown("gap_ms"), shown("delta_fme_bins"))


_SESSIONS = with_steps("SELECT line_no, coalesce(gap_ms, -1) AS gap_ms, passage_id FROM ses", "ses")


@query("sessionize", _SESSIONS)
def sessionize(spark, sf_dir):
    return passaged(spark, sf_dir).select("line_no", shown("gap_ms"), "passage_id")


@query("sessionize_bucketed", _SESSIONS)
def sessionize_bucketed(spark, sf_dir):
    return pre.sessionize(kept(spark, sf_dir), GAP, bucket_ms=1800).select("line_no", shown("gap_ms"), "passage_id")


@query("echo_drop_later", with_steps("SELECT line_no, time_ms, snr_db, coalesce(delta_fme_bins, -1) AS delta_fme_bins FROM ech WHERE NOT is_echo", "ech"))
def echo_drop_later(spark, sf_dir):
    return pre.preprocess(detections(spark, sf_dir), config()).flagged.filter("not is_echo").select("line_no", "time_ms", "snr_db", shown("delta_fme_bins"))


_BEST = with_steps("SELECT line_no, time_ms, snr_db FROM best WHERE NOT is_echo", "best")


@query("echo_best_snr", _BEST)
def echo_best_snr(spark, sf_dir):
    return pre.preprocess(detections(spark, sf_dir), config(strategy="best_snr")).flagged.filter("not is_echo").select("line_no", "time_ms", "snr_db")


@query("echo_best_snr_bucketed", _BEST)
def echo_best_snr_bucketed(spark, sf_dir):
    return pre.preprocess(detections(spark, sf_dir), config(strategy="best_snr", bucket_ms=1800)).flagged.filter("not is_echo").select("line_no", "time_ms", "snr_db")


@query("resessionize", with_steps("SELECT line_no, coalesce(gap_ms2, -1) AS gap_ms2, passage_id2 FROM clean"))
def resessionize(spark, sf_dir):
    return cleaned(spark, sf_dir).select("line_no", shown("gap_ms2"), "passage_id2")


@query(
    "pipeline_counters",
    with_steps(
        """SELECT (SELECT count(*) FROM det) AS n_raw, (SELECT count(*) FROM det) - (SELECT count(*) FROM art) AS n_artefacts, (SELECT count(*) FROM art) AS n_clean, (SELECT count(*) FROM ech WHERE is_echo) AS n_echoes,
        (SELECT count(*) FROM noe) AS n_no_echo, (SELECT count(*) FROM clean) AS n_filtered, (SELECT count(*) FROM ses2 WHERE fme_khz <= 18) AS n_social, (SELECT max(passage_id) FROM ses) AS n_sequences,
        (SELECT count(DISTINCT passage_id2) FROM ses2) AS n_sequences_no_echo, (SELECT count(DISTINCT passage_id2) FROM clean) AS n_passages_detected"""
    ),
)
def pipeline_counters(spark, sf_dir):
    return pre.preprocess(detections(spark, sf_dir), config()).counters.drop("recording_id")


_PASSAGES = "SELECT passage_id2 AS passage_id, min(time_ms) AS start_ms, max(time_ms) AS end_ms, count(*) AS n_chirps, median(fme_khz) AS fme_median_khz FROM clean GROUP BY ALL"


@query("passages", with_steps(_PASSAGES))
def passages(spark, sf_dir):
    return pre.passages(cleaned(spark, sf_dir)).drop("recording_id")


@query("passages_min_chirps", with_steps(f"SELECT * FROM ({_PASSAGES}) WHERE n_chirps >= 15"))
def passages_min_chirps(spark, sf_dir):
    return pre.passages(cleaned(spark, sf_dir), config(min_passage_chirps=15)).drop("recording_id")


@query("passage_species", with_steps(f"SELECT passage_id, fme_median_khz, {label_sql('fme_median_khz')} AS species FROM ({_PASSAGES})"))
def passage_species(spark, sf_dir):
    return pre.passages(cleaned(spark, sf_dir)).select("passage_id", "fme_median_khz", label(F.col("fme_median_khz")).alias("species"))


@query("nested_passages", with_steps("SELECT passage_id2 AS passage_id, count(*) AS n_chirps, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY time_ms, line_no) AS lines FROM clean GROUP BY ALL"))
def nested_passages(spark, sf_dir):
    return pre.passage_lines(cleaned(spark, sf_dir), BUCKET).select("passage_id", "n_chirps", "lines")


@query("species_counts", with_steps(f"SELECT {label_sql('fme_khz')} AS species, count(*) AS n FROM clean GROUP BY ALL"))
def species_counts(spark, sf_dir):
    return cleaned(spark, sf_dir).groupBy(label(F.col("fme_khz")).alias("species")).agg(F.count("*").alias("n"))


@query("fme_histogram", with_steps("""SELECT b.bin, coalesce(n, 0) AS n, 15.0 + b.bin * 0.625 AS bin_start, round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER () * 0.625), 6) AS density
    FROM (SELECT CAST(range AS INT) AS bin FROM range(80)) b LEFT JOIN (SELECT CAST(least(greatest(floor((fme_khz - 15.0) / 0.625), 0), 79) AS INT) AS bin, count(*) AS n FROM clean GROUP BY ALL) USING (bin)"""))
def fme_histogram(spark, sf_dir):
    return eda.histogram(cleaned(spark, sf_dir), F.col("fme_khz"), 15.0, 65.0, 80, density=True).withColumn("density", F.round("density", 6))


@query("gap_stats", with_steps("""SELECT median(gap_ms) AS median_gap, round(avg(gap_ms), 6) AS mean_gap, round(quantile_cont(gap_ms, 0.95), 6) AS p95_gap, round(avg(CASE WHEN gap_ms <= 10 THEN 1.0 ELSE 0 END), 6) AS share_short,
    round(avg(CASE WHEN gap_ms <= 100 THEN 1.0 ELSE 0 END), 6) AS share_long, count(*) FILTER (gap_ms > 100) AS n_beyond FROM ses WHERE gap_ms IS NOT NULL""", "ses"))
def gap_stats(spark, sf_dir):
    return eda.gap_stats(passaged(spark, sf_dir)).select("median_gap", r6("mean_gap"), r6("p95_gap"), r6("share_short"), r6("share_long"), "n_beyond")


@query("sequence_sizes", with_steps("SELECT count(*) AS n_sequences, median(n) AS median_size, round(avg(n), 6) AS mean_size, max(n) AS max_size FROM (SELECT count(*) AS n FROM ses GROUP BY passage_id)", "ses"))
def sequence_sizes(spark, sf_dir):
    return eda.sequence_sizes(passaged(spark, sf_dir)).withColumn("mean_size", F.round("mean_size", 6))


@query("fme_stability", with_steps("SELECT count(*) AS n_sequences, round(median(sd), 6) AS median_sd, round(avg(sd), 6) AS mean_sd FROM (SELECT stddev_samp(fme_khz) AS sd FROM ses GROUP BY passage_id HAVING count(*) >= 2)", "ses"))
def fme_stability(spark, sf_dir):
    return eda.fme_stability(passaged(spark, sf_dir)).select("n_sequences", r6("median_sd"), r6("mean_sd"))


@query("fme_correlation", with_steps("SELECT round(corr(fme_khz, ft_khz), 6) AS fme_ft, round(corr(fme_khz, fi_khz), 6) AS fme_fi FROM art", "art"))
def fme_correlation(spark, sf_dir):
    return eda.correlations(kept(spark, sf_dir)).select(r6("fme_ft"), r6("fme_fi"))


@query("sequence_durations", with_steps("SELECT passage_id, max(time_ms) - min(time_ms) AS duration_ms, count(*) AS n FROM ses GROUP BY passage_id", "ses"))
def sequence_durations(spark, sf_dir):
    return eda.durations(passaged(spark, sf_dir)).drop("recording_id")


@query("zone_summary", with_steps("""SELECT count(*) AS n, median(fme_khz) AS fme_median, round(quantile_cont(fme_khz, 0.1), 6) AS fme_q10, round(quantile_cont(fme_khz, 0.9), 6) AS fme_q90, median(snr_db) AS snr_median,
    round(quantile_cont(snr_db, 0.1), 6) AS snr_q10, round(quantile_cont(snr_db, 0.9), 6) AS snr_q90, min(time_ms) AS first_ms, max(time_ms) AS last_ms, round(count(*) / (SELECT count(*) FROM ses), 6) AS share,
    (SELECT count(DISTINCT passage_id) FROM z) AS n_sequences, (SELECT median(n) FROM (SELECT count(*) AS n FROM z GROUP BY passage_id)) AS median_per_sequence, (SELECT max(n) FROM (SELECT count(*) AS n FROM z GROUP BY passage_id)) AS max_per_sequence FROM z""",
    "ses", {"z": "SELECT * FROM ses WHERE fme_khz > 22 AND fme_khz < 28"}))
def zone_summary(spark, sf_dir):
    return eda.zone_summary(passaged(spark, sf_dir), 22, 28).withColumns({c: F.round(c, 6) for c in ("fme_q10", "fme_q90", "snr_q10", "snr_q90", "share")})


@query("top_sequences", with_steps("SELECT passage_id, count(*) AS n, min(time_ms) AS start_ms, max(time_ms) AS end_ms FROM ses GROUP BY passage_id ORDER BY n DESC, passage_id DESC LIMIT 10", "ses"))
def top_sequences(spark, sf_dir):
    return eda.top_sequences(passaged(spark, sf_dir)).drop("recording_id")


@query("clip_summary", with_steps(f"""SELECT passage_id, first_ms, last_ms, fme_median_khz, round(fme_std_khz, 6) AS fme_std_khz, ici_median_ms, snr_median_db, n_detections, {label_sql('fme_median_khz', COMMON_RULES, None)} AS species FROM (
    SELECT passage_id, min(time_ms) AS first_ms, max(time_ms) AS last_ms, median(fme_khz) AS fme_median_khz, coalesce(stddev_samp(fme_khz), 0) AS fme_std_khz, coalesce(median(ici), 0.0) AS ici_median_ms, median(snr_db) AS snr_median_db, count(*) AS n_detections
    FROM (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY passage_id ORDER BY time_ms, line_no) AS ici FROM ses) GROUP BY passage_id)""", "ses"))
def clip_summary(spark, sf_dir):
    return eda.clip_summary(passaged(spark, sf_dir)).drop("recording_id").withColumn("fme_std_khz", F.round("fme_std_khz", 6))


@query("segments", with_steps("SELECT passage_id AS segment, min(r) AS row_start, max(r) + 1 AS row_end, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY time_ms, line_no) - 1 AS r FROM ses) GROUP BY passage_id", "ses"))
def segments(spark, sf_dir):
    return pre.segments(kept(spark, sf_dir), GAP).drop("recording_id")


_DENSEST = with_steps("SELECT time_ms AS start_ms, time_ms + 3600 AS end_ms, n FROM (SELECT time_ms, count(*) OVER (ORDER BY time_ms RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS n FROM art) ORDER BY n DESC, time_ms LIMIT 1", "art")


@query("densest_window", _DENSEST)
def densest_window(spark, sf_dir):
    return activity.densest_window(kept(spark, sf_dir), 3600).drop("recording_id")


@query("densest_window_bucketed", _DENSEST)
def densest_window_bucketed(spark, sf_dir):
    return activity.densest_window_bucketed(kept(spark, sf_dir), 3600).drop("recording_id")


# Groups of a passage and a species stand for tracks, and tiles of time for scenarios, where SQL has no tracker.
_TRACKS = {
    "calls": f"SELECT concat(passage_id2, '/', {label_sql('fme_khz')}) AS track_id, {label_sql('fme_khz')} AS passage_species, time_ms, line_no, fme_khz FROM clean",
    "tracks": "SELECT track_id, passage_species, CAST(count(*) AS INT) AS n_chirps, min(time_ms) AS start_time_ms, max(time_ms) AS end_time_ms, median(fme_khz) AS fme_median_khz FROM calls GROUP BY ALL",
    "scen": """SELECT 'tiles' AS dataset, concat('s', range) AS scenario_id, CASE range % 3 WHEN 0 THEN 'alone' WHEN 1 THEN 'mixed' ELSE 'ici_sweep' END AS case_type, CAST(range // 3 AS INT) AS replicate_id, range * 40000 AS start_ms,
        range * 40000 + 30000 AS end_ms, CAST(range % 7 AS INT) AS expected_count, CASE range % 3 WHEN 2 THEN 'ici_delta_ms' ELSE '' END AS parameter_name, CASE range % 3 WHEN 2 THEN CAST(range % 5 * 10 AS DOUBLE) END AS parameter_value FROM range(67)""",
    "hits": "SELECT track_id, scenario_id, case_type, start_ms AS scenario_start, count(*) AS matched FROM calls JOIN scen ON time_ms BETWEEN start_ms AND end_ms GROUP BY ALL",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY matched DESC, scenario_start, scenario_id) AS place, count(*) OVER (PARTITION BY track_id) AS rivals FROM hits) WHERE place = 1",
    "asg": """SELECT t.track_id, coalesce(scenario_id, 'UNASSIGNED') AS scenario_id, coalesce(case_type, 'false_positive') AS case_type, n_chirps, CAST(coalesce(matched, 0) AS INT) AS matched_chirps,
        CASE WHEN matched IS NULL THEN 'unassigned_false_positive' WHEN matched < ceil(n_chirps / 2) THEN 'ambiguous_no_majority' WHEN rivals > 1 THEN 'ambiguous_majority' ELSE 'assigned' END AS assignment_status,
        start_time_ms, end_time_ms, passage_species FROM tracks t LEFT JOIN top USING (track_id)""",
    "met": """SELECT *, signed_error * signed_error AS squared_error, abs(signed_error) AS absolute_error, signed_error = 0 AS exact_match, signed_error < 0 AS undercount, signed_error > 0 AS overcount FROM (
        SELECT scen.*, CAST(coalesce(n, 0) AS INT) AS detected_count, CAST(coalesce(n, 0) AS INT) - expected_count AS signed_error FROM scen LEFT JOIN (SELECT scenario_id, count(*) AS n FROM asg GROUP BY ALL) USING (scenario_id))""",
}


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = label(F.col("fme_khz"))
    return cleaned(spark, sf_dir).select(F.concat_ws("/", "passage_id2", species).alias("track_id"), species.alias("passage_species"), "time_ms", "line_no", "fme_khz")


def _tracks(calls: DataFrame) -> DataFrame:
    return calls.groupBy("track_id", "passage_species").agg(F.count("*").cast("int").alias("n_chirps"), F.min("time_ms").alias("start_time_ms"), F.max("time_ms").alias("end_time_ms"), F.median("fme_khz").alias("fme_median_khz"))


def _scenarios(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    kind = F.when(i % 3 == 0, "alone").when(i % 3 == 1, "mixed").otherwise("ici_sweep")
    sweep = i % 3 == 2
    return spark.range(67).select(
        F.lit("tiles").alias("dataset"), F.concat(F.lit("s"), i.cast("string")).alias("scenario_id"), kind.alias("case_type"), F.floor(i / 3).cast("int").alias("replicate_id"), (i * 40000).alias("start_ms"), (i * 40000 + 30000).alias("end_ms"),
        (i % 7).cast("int").alias("expected_count"), F.when(sweep, "ici_delta_ms").otherwise("").alias("parameter_name"), F.when(sweep, (i % 5 * 10).cast("double")).alias("parameter_value"),
    )


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    return validation.assign_tracks(_tracks(calls), calls, _scenarios(spark))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.scenario_metrics(_scenarios(spark), _assigned(spark, sf_dir))


@query("activity_bins", with_steps("""SELECT species, bin, bin * 3600 AS bin_start_ms, count(track_id) AS n_tracks FROM (SELECT DISTINCT passage_species AS species FROM tracks), (SELECT range AS bin FROM range((SELECT max(end_time_ms) // 3600 + 1 FROM tracks)))
    LEFT JOIN tracks ON passage_species = species AND bin * 3600 <= end_time_ms AND (bin + 1) * 3600 >= start_time_ms GROUP BY ALL""", more=_TRACKS))
def activity_bins(spark, sf_dir):
    return activity.activity_bins(_tracks(_calls(spark, sf_dir)).withColumnRenamed("passage_species", "species"), 3600)


@query("track_intervals", with_steps("SELECT track_id, time_ms, ici_ms FROM (SELECT track_id, time_ms, time_ms - lag(time_ms) OVER (PARTITION BY track_id ORDER BY time_ms) AS ici_ms FROM calls) WHERE ici_ms > 0", more=_TRACKS))
def track_intervals(spark, sf_dir):
    return activity.intervals(_calls(spark, sf_dir)).select("track_id", "time_ms", "ici_ms")


@query("visible_tracks", with_steps("SELECT track_id, n_chirps FROM tracks WHERE EXISTS (SELECT 1 FROM calls c WHERE c.track_id = tracks.track_id AND time_ms BETWEEN 1000000 AND 1200000)", more=_TRACKS))
def visible_tracks(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return activity.visible_tracks(_tracks(calls), calls, 1_000_000, 1_200_000).select("track_id", "n_chirps")


@query("point_in_interval", with_steps("SELECT track_id, scenario_id, matched FROM hits", more=_TRACKS))
def point_in_interval(spark, sf_dir):
    return validation.match_counts(_calls(spark, sf_dir), _scenarios(spark)).select("track_id", "scenario_id", "matched")


@query("interval_points", with_steps("SELECT line_no, scenario_id FROM calls JOIN scen ON time_ms BETWEEN start_ms AND end_ms", more=_TRACKS))
def interval_points(spark, sf_dir):
    return points_in_intervals(_calls(spark, sf_dir), "time_ms", _scenarios(spark), "start_ms", "end_ms", 20_000).select("line_no", "scenario_id")


@query("track_assignment", with_steps("SELECT * FROM asg", more=_TRACKS))
def track_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("scenario_metrics", with_steps("SELECT scenario_id, case_type, expected_count, detected_count, signed_error, absolute_error, squared_error, exact_match, undercount, overcount FROM met", more=_TRACKS))
def scenario_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).drop("dataset", "replicate_id", "start_ms", "parameter_name", "parameter_value")


@query("summary_grouping_sets", with_steps("""SELECT CASE WHEN grouping(case_type) = 1 THEN 'global' ELSE case_type END AS "group", CAST(grouping(case_type) AS INT) AS group_id, count(*) AS n_scenarios, round(avg(signed_error), 6) AS bias_mean, round(avg(absolute_error), 6) AS mae,
    round(sqrt(avg(squared_error)), 6) AS rmse, round(avg(CAST(exact_match AS INT)), 6) AS exact_rate, round(avg(CAST(undercount AS INT)), 6) AS undercount_rate, round(avg(CAST(overcount AS INT)), 6) AS overcount_rate FROM met GROUP BY GROUPING SETS ((), (case_type))""", more=_TRACKS))
def summary_grouping_sets(spark, sf_dir):
    found = validation.grouped_errors(_metrics(spark, sf_dir))
    return found.select("group", "group_id", "n_scenarios", *(r6(c) for c in ("bias_mean", "mae", "rmse", "exact_rate", "undercount_rate", "overcount_rate")))


@query("sweep_curve", with_steps("SELECT case_type, parameter_value, round(avg(absolute_error), 6) AS mae, round(avg(CAST(exact_match AS INT)), 6) AS exact_rate, count(*) AS n FROM met WHERE parameter_value IS NOT NULL GROUP BY ALL", more=_TRACKS))
def sweep_curve(spark, sf_dir):
    return validation.sweep_curve(_metrics(spark, sf_dir)).select("case_type", "parameter_value", r6("mae"), r6("exact_rate"), "n")


@query("error_histogram", with_steps("SELECT signed_error, count(*) AS n FROM met GROUP BY ALL", more=_TRACKS))
def error_histogram(spark, sf_dir):
    return validation.error_histogram(_metrics(spark, sf_dir))


@query("scenario_windows", with_steps("""SELECT concat('w', start_time_ms // 40000) AS scenario_id, min_by(passage_species, (start_time_ms, track_id)) AS case_type, min(start_time_ms) - 20 AS start_ms, max(end_time_ms) + 20 AS end_ms, min_by(n_chirps, (start_time_ms, track_id)) AS expected_count,
    'n_chirps' AS parameter_name, CAST(min_by(n_chirps, (start_time_ms, track_id)) AS DOUBLE) AS parameter_value FROM tracks GROUP BY start_time_ms // 40000""", more=_TRACKS))
def scenario_windows(spark, sf_dir):
    return validation.scenarios_from_truth(truth_of_tracks(spark, sf_dir)).drop("dataset", "replicate_id")


def truth_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth table: the tracks that start in a window of 40,000 ticks are one scenario."""
    return _tracks(_calls(spark, sf_dir)).select(
        F.lit("d").alias("dataset"), F.concat(F.lit("w"), F.floor(F.col("start_time_ms") / 40000).cast("string")).alias("scenario_id"), F.col("passage_species").alias("case_type"), F.lit(1).alias("replicate_id"), F.col("track_id").alias("individual_id"),
        F.col("start_time_ms").alias("start_ms"), F.col("end_time_ms").alias("end_ms"), F.col("n_chirps").alias("expected_count"), F.concat(F.lit("n_chirps="), F.col("n_chirps").cast("string")).alias("notes"),
    )

@query("notes_parse", """SELECT event_id, CASE WHEN v IS NULL THEN '' ELSE 'k' END AS name, v AS value FROM (SELECT event_id, TRY_CAST(CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 1 THEN 'x=' || event_id END AS DOUBLE) AS v FROM events)""")
def notes_parse(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    notes = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k="), F.col("event_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("k=x="), F.col("event_id").cast("string"))).otherwise("plain")
    return events.select("event_id", units.parse_parameter(notes).alias("p")).select("event_id", "p.name", "p.value")


@query("khz_to_bin", """SELECT event_id, CAST(least(greatest(round_even(value / 0.390625, 0), 0), 255) AS INT) AS bin, CAST(floor(least(greatest(value / 0.390625, 0), 255) + 0.5) AS INT) AS bin_half_up, CAST(greatest(1, round_even(value / 1.28, 0)) AS INT) AS windows FROM events""")
def khz_to_bin(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("value")
    return events.select("event_id", units.khz_to_bin(v).alias("bin"), units.khz_to_bin(v, "simulator").alias("bin_half_up"), units.duration_to_windows(v).alias("windows"))


@query("kde_density", with_steps("""SELECT x, round(sum(n * exp(-0.5 * ((x - v) / 1.5) * ((x - v) / 1.5))) / (max(total) * 1.5 * sqrt(2 * pi())), 9) AS density FROM (SELECT 15 + range * 0.5 AS x FROM range(101)), (SELECT fme_khz AS v, count(*) AS n, sum(count(*)) OVER () AS total FROM clean GROUP BY fme_khz) GROUP BY x"""))
def kde_density(spark, sf_dir):
    grid = spark.range(101).select((15 + F.col("id") * 0.5).alias("x"))
    return density.kde_table(cleaned(spark, sf_dir), grid, 1.5).select("x", F.round("density", 9).alias("density"))


_MEANS, _SIGMAS, _WEIGHTS = (27.0, 38.0, 46.5, 55.0), (0.8, 0.9, 1.1, 1.0), (0.2, 0.3, 0.3, 0.2)
_SCORES = [f"(ln({w}) - ln({s}) - 0.5 * ((fme_khz - {m}) / {s}) * ((fme_khz - {m}) / {s}))" for m, s, w in zip(_MEANS, _SIGMAS, _WEIGHTS)]


@query("mixture_predict", with_steps(f"SELECT line_no, CAST(list_position([{', '.join(_SCORES)}], greatest({', '.join(_SCORES)})) - 1 AS INT) AS component, round(exp(greatest({', '.join(_SCORES)})) / ({' + '.join(f'exp{s}' for s in _SCORES)}), 6) AS share FROM clean"))
def mixture_predict(spark, sf_dir):
    x = F.col("fme_khz")
    return cleaned(spark, sf_dir).select("line_no", predict(x, _MEANS, _SIGMAS, _WEIGHTS).alias("component"), F.round(F.array_max(posterior(x, _MEANS, _SIGMAS, _WEIGHTS)), 6).alias("share"))


@query("cluster_report", with_steps(f"""SELECT label, count(fme_khz) AS n, round(count(fme_khz) / sum(count(fme_khz)) OVER (), 6) AS share, median(fme_khz) AS median, {label_sql('median(fme_khz)')} AS species FROM (SELECT CAST(range AS INT) AS label FROM range(4))
    LEFT JOIN (SELECT fme_khz, CAST(list_position([{', '.join(_SCORES)}], greatest({', '.join(_SCORES)})) - 1 AS INT) AS label FROM clean) USING (label) GROUP BY label"""))
def cluster_report(spark, sf_dir):
    return clusters(cleaned(spark, sf_dir), _MEANS, _SIGMAS, _WEIGHTS)


def clusters(rows: DataFrame, means, sigmas, weights) -> DataFrame:
    """Rows, share, median and species of each component, those without rows included."""
    labels = rows.sparkSession.range(len(means)).select(F.col("id").cast("int").alias("label"))
    found = rows.select("fme_khz", predict(F.col("fme_khz"), means, sigmas, weights).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.median("fme_khz").alias("median"))
    found = labels.join(found, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.select("label", "n", F.round(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), 6).alias("share"), "median", label(F.col("median"), LATIN_RULES).alias("species"))


@query("fnv1a_hash", """SELECT DISTINCT event_type, CAST(list_reduce(list_transform(string_split(event_type, ''), lambda c: CAST(unicode(c) AS HUGEINT)), lambda h, c: xor(CAST(h AS BIGINT), CAST(c AS BIGINT))::HUGEINT * 16777619 % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT) AS hash FROM events""")
def fnv1a_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().select("event_type", units.fnv1a(F.col("event_type")).alias("hash"))


@query("labels_and_formats", with_steps("""SELECT track_id, printf('%.2f h', start_time_ms / 3600000.0) AS hours, printf('%d:%02d:%02d', start_time_ms // 3600000, start_time_ms // 1000 % 3600 // 60, start_time_ms // 1000 % 60) AS clock,
    concat(track_id, '/', list_reduce(list_transform(string_split(passage_species, ' '), lambda w: left(w, 1)), lambda a, b: a || b), '/n', n_chirps) AS short FROM tracks""", more=_TRACKS))
def labels_and_formats(spark, sf_dir):
    return _tracks(_calls(spark, sf_dir)).select("track_id", units.format_hours(F.col("start_time_ms")).alias("hours"), units.format_clock(F.col("start_time_ms")).alias("clock"), units.short_track_label(F.col("track_id"), F.col("passage_species"), F.col("n_chirps")).alias("short"))


@query("semi_anti_stores", "SELECT store_id, n_rows, store_id IN (SELECT 't' || (c_custkey % 5) FROM customer WHERE c_custkey % 5 < 3) AS used FROM (SELECT 't' || (event_id % 5) AS store_id, count(*) AS n_rows FROM events GROUP BY ALL)")
def semi_anti_stores(spark, sf_dir):
    stores = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("store_id")).agg(F.count("*").alias("n_rows"))
    clips = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 5 < 3").select(F.concat(F.lit("t"), (F.col("c_custkey") % 5).cast("string")).alias("store_id"))
    used = stores.join(clips, "store_id", "left_semi").withColumn("used", F.lit(True))
    return used.unionByName(stores.join(clips, "store_id", "left_anti").withColumn("used", F.lit(False)))


@query("clip_edits", "SELECT 'c' || event_id AS clip_id, value + CASE WHEN event_id % 7 = 0 THEN 1000 ELSE 0 END AS start_ms FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT 'c' || event_id || '-copy', value + CASE WHEN event_id % 7 = 0 THEN 2000 ELSE 1000 END FROM events WHERE event_id % 5 <> 0 AND event_id % 11 = 0")
def clip_edits(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    empty = spark.createDataFrame([], CLIP)
    named = events.select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("clip_id"), F.col("value").alias("start_ms"), "event_id", F.lit("i").alias("individual_id"), F.lit("s").alias("sequence_id"), F.lit(1).cast("long").alias("seed"))
    clips = empty.unionByName(named.drop("event_id"), allowMissingColumns=True)
    pick = lambda test: named.filter(test).select("clip_id")
    moved = clips.join(pick("event_id % 7 = 0"), "clip_id", "left_semi").withColumn("start_ms", F.col("start_ms") + 1000)
    edited = clip_tables.delete_clips(clip_tables.upsert_clips(clips, moved), pick("event_id % 5 = 0"))
    return clip_tables.add_clips(edited, clip_tables.duplicates(edited, pick("event_id % 11 = 0"))).select("clip_id", "start_ms")


@query("band_lookup", with_steps(f"SELECT line_no, {label_sql('fme_khz', BANDS).replace(repr('Indetermine'), repr('track-low'))} AS band, {label_sql('fme_khz', COMMON_RULES, None)} AS common_name FROM clean"))
def band_lookup(spark, sf_dir):
    x = F.col("fme_khz")
    return cleaned(spark, sf_dir).select("line_no", band(x).alias("band"), label(x, COMMON_RULES, None).alias("common_name"))


@query("species_dimension", f"""SELECT event_id, coalesce(common_name, 'Pipistrelle de Kuhl') AS common_name FROM events LEFT JOIN (VALUES {', '.join(f"('{t[0]}', '{t[1]}')" for t in SPECIES_NAMES)}) s(id, common_name)
    ON s.id = CASE event_type WHEN 'click' THEN 'pip-common' WHEN 'view' THEN 'pip-pygmy' WHEN 'error' THEN 'serotine' ELSE 'other' END""")
def species_dimension(spark, sf_dir):
    """Species by id, the first one for an unknown one. Their names are a table of six rows."""
    kinds = spark.createDataFrame([(t[0], t[1]) for t in SPECIES_NAMES], "id string, common_name string")
    kind = F.when(F.col("event_type") == "click", "pip-common").when(F.col("event_type") == "view", "pip-pygmy").when(F.col("event_type") == "error", "serotine").otherwise("other")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", kind.alias("id"))
    return events.join(F.broadcast(kinds), "id", "left").select("event_id", F.coalesce("common_name", F.lit(SPECIES_NAMES[0][1])).alias("common_name"))


_STORE = {"st": "SELECT *, row_number() OVER (ORDER BY time_ms, line_no) - 1 AS r FROM ses", "seg": "SELECT passage_id AS segment, min(r) AS row_start, max(r) + 1 AS row_end FROM st GROUP BY passage_id"}


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = kept(spark, sf_dir)
    sized = pre.mark_steps(rows, GAP, number="row_idx", bucket_ms=BUCKET)
    store = sized.withColumn("store_id", F.lit("s")).withColumn("bin_khz", F.lit(0.390625)).drop("fme_khz", "fi_khz", "ft_khz", "gap_ms", "passage_id")
    clips = clip_tables.import_as_clips(eda.clip_summary(sized.drop("row_idx")), pre.segments(rows, GAP, BUCKET), "s")
    return clips, store


@query("imported_detections", with_steps("SELECT line, time_ms + CASE WHEN segment % 2 = 0 THEN 500 ELSE 0 END AS time_ms, pos_fme, fme_khz, source_clip_id FROM (SELECT r - row_start AS line, time_ms, pos_fme, fme_khz, segment, concat('s-', segment) AS source_clip_id FROM st JOIN seg ON r >= row_start AND r < row_end)", "ses", _STORE))
def imported_detections(spark, sf_dir):
    """Rows of imported clips, every second clip moved by 500."""
    clips, store = _imported(spark, sf_dir)
    even = F.split("clip_id", "-")[1].cast("long") % 2 == 0
    moved = clips.withColumn("start_ms", F.when(even, F.col("start_ms") + 500).otherwise(F.col("start_ms")))
    return clip_tables.imported_detections(moved, store, clamp=True).select(F.element_at(F.split("detection_id", "-"), -1).cast("long").alias("line"), "time_ms", "pos_fme", "fme_khz", "source_clip_id")


@query("visible_clips", with_steps("SELECT concat('s-', passage_id) AS clip_id, count(*) AS n FROM ses GROUP BY passage_id HAVING max(time_ms) >= 1000000 AND min(time_ms) <= 1200000", "ses"))
def visible_clips(spark, sf_dir):
    return clip_tables.visible(_imported(spark, sf_dir)[0], 1_000_000, 1_200_000).select("clip_id", (F.col("row_end") - F.col("row_start")).cast("long").alias("n"))


@query("id_sets", with_steps("""SELECT species, len(list_distinct(list_concat(a, b))) AS n_union, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_except, len(list_filter(a, lambda x: list_contains(b, x))) AS n_both FROM (
    SELECT passage_species AS species, coalesce(list(DISTINCT CAST(split_part(track_id, '/', 1) AS BIGINT)) FILTER (n_chirps >= 5), []) AS a, coalesce(list(DISTINCT CAST(split_part(track_id, '/', 1) AS BIGINT)) FILTER (start_time_ms % 2 = 0), []) AS b FROM tracks GROUP BY ALL)""", more=_TRACKS))
def id_sets(spark, sf_dir):
    """Union, difference and intersection of passages by species: those of five calls or more, and those of even start."""
    passage = F.split("track_id", "/")[0].cast("long")
    sets = _tracks(_calls(spark, sf_dir)).groupBy(F.col("passage_species").alias("species")).agg(F.collect_set(F.when(F.col("n_chirps") >= 5, passage)).alias("a"), F.collect_set(F.when(F.col("start_time_ms") % 2 == 0, passage)).alias("b"))
    return sets.select("species", F.size(F.array_union("a", "b")).cast("long").alias("n_union"), F.size(F.array_except("a", "b")).cast("long").alias("n_except"), F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"))


@query("sensor_lines", with_steps("SELECT line_no, concat_ws(' ', time_ms, pos_fme, pos_fi, pos_ft, duration_windows, snr_db) AS line FROM det", "det"))
def sensor_lines(spark, sf_dir):
    from ..sinks.files import ROW

    return detections(spark, sf_dir).select("line_no", F.concat_ws(" ", *ROW).alias("line"))


@query("capped_sizes", with_steps("SELECT least(n, 50) AS size, count(*) AS n FROM (SELECT count(*) AS n FROM ses GROUP BY passage_id) GROUP BY 1", "ses"))
def capped_sizes(spark, sf_dir):
    return eda.durations(passaged(spark, sf_dir)).groupBy(F.least("n", F.lit(50)).cast("long").alias("size")).agg(F.count("*").alias("n"))


@query("echo_distances", with_steps("SELECT least(delta_fme_bins, 20) AS bins, is_echo, count(*) AS n FROM ech WHERE delta_fme_bins IS NOT NULL GROUP BY ALL", "ech"))
def echo_distances(spark, sf_dir):
    flagged = pre.preprocess(detections(spark, sf_dir), config()).flagged.filter("delta_fme_bins is not null")
    return flagged.groupBy(F.least("delta_fme_bins", F.lit(20)).alias("bins"), "is_echo").agg(F.count("*").alias("n"))


@query("call_curves", with_steps("SELECT line_no, k, round(ft_khz + (fi_khz - ft_khz) * exp(-3.5 * k / 8), 6) AS khz FROM clean, (SELECT CAST(range AS INT) AS k FROM range(9))"))
def call_curves(spark, sf_dir):
    """The frequency along each call, as a chart draws it."""
    return cleaned(spark, sf_dir).select("line_no", F.posexplode(clip_tables.call_curve()).alias("k", "khz")).withColumn("khz", F.round("khz", 6))


@query("track_overlaps", with_steps("SELECT a.track_id AS a, b.track_id AS b FROM tracks a JOIN tracks b ON a.track_id < b.track_id AND a.start_time_ms <= b.end_time_ms AND a.end_time_ms >= b.start_time_ms", more=_TRACKS))
def track_overlaps(spark, sf_dir):
    """Pairs of tracks that overlap in time, by the hours that both touch."""
    spans = _tracks(_calls(spark, sf_dir)).select("track_id", F.col("start_time_ms").alias("s"), F.col("end_time_ms").alias("e"))
    listed = spans.withColumn("hour", F.explode(F.sequence(F.floor(F.col("s") / 3600), F.floor(F.col("e") / 3600))))
    a, b = listed.alias("a"), listed.alias("b")
    met = (F.col("a.hour") == F.col("b.hour")) & (F.col("a.track_id") < F.col("b.track_id")) & overlaps(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))
    return a.join(b, met).select(F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b")).distinct()


# Models, trackers, files and streams.


def _figures(models: DataFrame) -> DataFrame:
    """A row for each mean, deviation, weight, threshold and peak of a model."""
    lists = [F.struct(F.lit(name).alias("figure"), F.col(column).alias("v")) for name, column in (("mean", "means"), ("sigma", "sigmas"), ("weight", "weights"), ("threshold", "thresholds"), ("peak", "peaks"))]
    return models.select(F.inline(F.array(*lists))).select("figure", F.posexplode("v").alias("place", "value")).withColumn("value", F.round("value", 4))


_FIGURES = """SELECT figure, CAST(place - 1 AS INT) AS place, round(value, 4) AS value FROM (SELECT 'mean' AS figure, component AS place, m AS value FROM mix UNION ALL SELECT 'sigma', component, s FROM mix UNION ALL SELECT 'weight', component, w FROM mix
    UNION ALL SELECT 'threshold', j, spot FROM thr WHERE level = (SELECT max(level) FROM thr) UNION ALL SELECT 'peak', place, x FROM peak)"""
_WEB = MixtureConfig(flavor="web", scale=0.5)


@query("gmm_fit", density_sql(_FIGURES, [MixtureConfig()]))
def gmm_fit(spark, sf_dir):
    return _figures(mixtures.fit_models(cleaned(spark, sf_dir)))


@query("gmm_fit_web", density_sql(_FIGURES, [_WEB]))
def gmm_fit_web(spark, sf_dir):
    return _figures(mixtures.fit_models(cleaned(spark, sf_dir), [_WEB]))


_SWEEP = [MixtureConfig(bandwidth=b, prominence=p) for b in ("scott", "silverman") for p in (0.05, 0.10)]


@query("kde_sweep", density_sql("SELECT CAST(config AS INT) AS config, CAST(k AS INT) AS k, CAST(place - 1 AS INT) AS place, round(x, 6) AS peak FROM peak", _SWEEP))
def kde_sweep(spark, sf_dir):
    """Peaks by bandwidth rule and least prominence."""
    found = mixtures.densities(cleaned(spark, sf_dir), _SWEEP).select("config", F.size("peaks").alias("k"), F.posexplode("peaks").alias("place", "peak"))
    return found.select("config", "k", "place", r6("peak"))


@query("mixture_components", density_sql("SELECT CAST(component - 1 AS INT) AS component, round(m, 6) AS mean, round(s, 6) AS sigma, round(w, 6) AS weight FROM mix", [MixtureConfig()]))
def mixture_components(spark, sf_dir):
    """The fitted mixture, a row a component."""
    found = mixtures.fit_models(cleaned(spark, sf_dir)).select(F.posexplode(F.arrays_zip("means", "sigmas", "weights")).alias("component", "c"))
    return found.select("component", r6("c.means", "mean"), r6("c.sigmas", "sigma"), r6("c.weights", "weight"))


@query("gmm_curve", density_sql("SELECT CAST(i AS INT) AS point, round(any_value(x), 6) AS x, round(any_value(y), 6) AS density, round(sum(w * exp(-0.5 * pow((x - m) / s, 2)) / (s * sqrt(2 * pi()))), 6) AS mixture FROM grd, mix GROUP BY i", [MixtureConfig()]))
def gmm_curve(spark, sf_dir):
    """Density and mixture along the grid, for drawing."""
    model = mixtures.fit_models(cleaned(spark, sf_dir))
    points = model.select("means", "sigmas", "weights", F.posexplode(F.arrays_zip("grid", "density")).alias("point", "g"))
    z = F.zip_with(F.zip_with("means", "sigmas", lambda m, s: F.struct(m.alias("m"), s.alias("s"))), "weights", lambda p, w: w * units.normal_density(F.col("g.grid"), p["m"], p["s"]))
    return points.select("point", r6("g.grid", "x"), r6("g.density", "density"), F.round(F.aggregate(z, F.lit(0.0), lambda a, b: a + b), 6).alias("mixture"))


#: Gaps in ticks of the passages that are counted.
_COUNT_GAP, _COUNT_ECHO = 200, 20


def _tracks_sql(select: str) -> str:
    return tracker_sql(select, _COUNT_GAP, _COUNT_ECHO)


def _counted(spark, sf_dir, gap: int = _COUNT_GAP, echo: int = _COUNT_ECHO, split: SplitConfig = SplitConfig()) -> tuple[DataFrame, counting.Counted]:
    clean = cleaned(spark, sf_dir, passage_gap_ms=gap, echo_gap_ms=echo, strategy="best_snr")
    return clean, counting.count_individuals(clean, split)


@query("species_split", _tracks_sql("SELECT passage_id, 0::BIGINT AS packet, n, fme_khz FROM base"))
def species_split(spark, sf_dir):
    return _counted(spark, sf_dir)[1].calls.groupBy("passage_id", "packet").agg(F.count("*").alias("n"), F.first("packet_fme_khz").alias("fme_khz"))


@query("tracks", _tracks_sql("SELECT * FROM trk"))
def tracks(spark, sf_dir):
    return _counted(spark, sf_dir)[1].tracks.drop("recording_id")


_WHOLE = SplitConfig(min_chirps=2**62)


@query("tracks_unsplit", tracker_sql("SELECT * FROM trk", GAP, ECHO, _WHOLE))
def tracks_unsplit(spark, sf_dir):
    """Tracks through long passages of all species together."""
    return _counted(spark, sf_dir, GAP, ECHO, _WHOLE)[1].tracks.drop("recording_id")


@query("tracks_by_species", _tracks_sql("SELECT passage_species, count(*) AS n_tracks, CAST(sum(n_chirps) AS BIGINT) AS n_chirps, count(*) FILTER (suspicious_short_ici) AS n_suspicious FROM trk GROUP BY passage_species"))
def tracks_by_species(spark, sf_dir):
    return _counted(spark, sf_dir)[1].tracks.groupBy("passage_species").agg(F.count("*").alias("n_tracks"), F.sum("n_chirps").alias("n_chirps"), F.count_if("suspicious_short_ici").alias("n_suspicious"))


@query("counting_summary", _tracks_sql("""SELECT (SELECT count(DISTINCT passage_id2) FROM clean) AS n_passages_detected, count(*) AS n_individuals_estimated, count(*) FILTER (suspicious_short_ici) AS n_suspicious_short_ici_tracks,
    (SELECT '{' || string_agg('"' || passage_species || '":' || n, ',' ORDER BY passage_species) || '}' FROM (SELECT passage_species, count(*) AS n FROM trk GROUP BY passage_species)) AS by_species FROM trk"""))
def counting_summary(spark, sf_dir):
    return _counted(spark, sf_dir)[1].summary.select("n_passages_detected", "n_individuals_estimated", "n_suspicious_short_ici_tracks", F.to_json("individuals_by_species").alias("by_species"))


@query("tracks_csv", _tracks_sql("""SELECT track_id, passage_id, packet_id, passage_species, start_time_ms, end_time_ms, n_chirps, printf('%.6f', fme_median_khz) AS fme_median_khz,
    coalesce(printf('%.6f', ici_median_ms), 'nan') AS ici_median_ms, CAST(suspicious_short_ici AS VARCHAR) AS suspicious_short_ici FROM trk"""))
def tracks_csv(spark, sf_dir):
    from ..sinks.files import tracks_csv_rows

    return tracks_csv_rows(_counted(spark, sf_dir)[1].tracks)


def _bootstrap_sql() -> str:
    """Each scenario's Poisson weight in each resample from a hash of both, sums by resample, and their quantiles."""
    draw = "CAST('0x' || substr(md5(scenario_id || ':' || resample || ':{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0"
    steps = []
    for k, limit in enumerate(validation.POISSON):
        steps.append(f"WHEN u < {limit!r} THEN {k}")
    weight = f"CASE {' '.join(steps)} ELSE {len(validation.POISSON)} END"
    parts = []
    for k, (name, column) in enumerate((("bias", "signed_error"), ("mae", "absolute_error"), ("exact", "CAST(exact_match AS INT)"))):
        parts.append(f"SELECT '{name}' AS m, group_id, \"group\", resample, sum(w * x)::DOUBLE / nullif(sum(w), 0) AS v FROM (SELECT *, {weight} AS w FROM (SELECT *, {draw.format(seed=validation.SEED + k)} AS u, {column} AS x FROM g, (SELECT range AS resample FROM range({validation.SAMPLES})))) GROUP BY ALL")
    ends = ", ".join(f"round(quantile_cont(v, {q}) FILTER (m = '{n}'), 6) AS {n}_ci_{e}" for n in ("bias", "mae", "exact") for e, q in (("low", 0.025), ("high", 0.975)))
    grouped = "SELECT met.*, group_id, CASE group_id WHEN 1 THEN 'global' ELSE case_type END AS \"group\" FROM met, (SELECT unnest([0, 1]) AS group_id)"
    return with_steps(f'SELECT CAST(group_id AS INT) AS group_id, "group", {ends} FROM s GROUP BY group_id, "group"', more=_TRACKS | {"g": grouped, "s": " UNION ALL ".join(parts)})


@query("bootstrap_ci", _bootstrap_sql())
def bootstrap_ci(spark, sf_dir):
    found = validation.bootstrap_table(_metrics(spark, sf_dir))
    return found.select("group_id", "group", *(r6(f"{n}_ci_{e}") for n in ("bias", "mae", "exact") for e in ("low", "high")))


@query("sensor_round_trip", with_steps("SELECT time_ms, pos_fme, pos_fi, pos_ft, duration_windows, snr_db FROM det", "det"))
def sensor_round_trip(spark, sf_dir):
    """Detections written as a log of ordered part files and read back by byte ranges."""
    from ..sinks.files import write_sensor_text
    from ..sources.sensor_text import read_sensor_text

    path = f"{scratch(spark)}/log"
    write_sensor_text(detections(spark, sf_dir), path)
    return read_sensor_text(spark, path)[0].drop("recording_id", "line_no")


@query("stream_passages")
def stream_passages(spark, sf_dir):
    """A stream of the cleaned detections, in one micro-batch, kept as a table."""
    from ..schema import DETECTION
    from ..streaming.passages import passage_writer, read_passages

    folder = scratch(spark)
    pre.drop_artefacts(detections(spark, sf_dir)).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(DETECTION).parquet(f"{folder}/in")
    passage_writer(rows, GAP, f"{folder}/out", BUCKET).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return read_passages(spark, f"{folder}/out").select("line_no", shown("gap_ms"), "passage_id")


ORACLE_SQL["stream_passages"] = _SESSIONS
