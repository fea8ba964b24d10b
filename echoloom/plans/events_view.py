"""The `events` table read as detections, one tick a second, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Passage and echo gap in ticks, for these tables.
GAP, ECHO = 1000, 60
#: Ticks of a bucket of time.
BUCKET = 7200
RECORDING = "events"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "ts", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.when(F.col("event_type") == "click", 97).when(F.col("event_type") == "view", 119).when(F.col("event_type") == "purchase", 141).when(F.col("event_type") == "error", 69).otherwise(45)
    fme, none = base + k % 3 - 1, F.col("event_id") % 20 == 0
    shown = lambda c: F.when(none, 0).otherwise(c).cast("int")
    time = F.expr("unix_micros(cast(ts as timestamp)) div 1000000 - 1704067200")
    return events.select(
        F.lit(RECORDING).alias("recording_id"), F.col("event_id").cast("long").alias("line_no"), time.cast("long").alias("time_ms"), shown(fme).alias("pos_fme"), shown(fme + 3 + k % 8).alias("pos_fi"),
        shown(fme - 2 - k % 4).alias("pos_ft"), shown(3 + k % 10).alias("duration_windows"), shown(19 + F.floor("value").cast("int") % 22).alias("snr_db"),
    )


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_FME = f"(CASE event_type WHEN 'click' THEN 97 WHEN 'view' THEN 119 WHEN 'purchase' THEN 141 WHEN 'error' THEN 69 ELSE 45 END + {_K} % 3 - 1)"


def _shown(value: str) -> str:
    return f"CAST(CASE WHEN event_id % 20 = 0 THEN 0 ELSE {value} END AS INT)"


#: Common table expressions in order; each builds on those before.
_STEPS = {
    "det": f"""SELECT event_id AS line_no, CAST(epoch_us(ts) // 1000000 AS BIGINT) - 1704067200 AS time_ms, {_shown(_FME)} AS pos_fme, {_shown(f'{_FME} + 3 + {_K} % 8')} AS pos_fi,
        {_shown(f'{_FME} - 2 - {_K} % 4')} AS pos_ft, {_shown(f'3 + {_K} % 10')} AS duration_windows, {_shown('19 + CAST(floor(value) AS INT) % 22')} AS snr_db FROM events""",
    "khz": "SELECT *, pos_fme * 0.390625::DOUBLE AS fme_khz, pos_fi * 0.390625::DOUBLE AS fi_khz, pos_ft * 0.390625::DOUBLE AS ft_khz FROM det",
    "art": "SELECT * FROM khz WHERE NOT (pos_fme = 0 AND snr_db = 0 AND duration_windows = 0)",
    "gaps": "SELECT *, time_ms - lag(time_ms) OVER o AS gap_ms, abs(pos_fme - lag(pos_fme) OVER o) AS delta_fme_bins FROM art WINDOW o AS (ORDER BY time_ms, line_no)",
    "ses": f"SELECT *, CAST(sum(CASE WHEN gap_ms IS NULL OR gap_ms >= {GAP} THEN 1 ELSE 0 END) OVER (ORDER BY time_ms, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passage_id FROM gaps",
    "lnk": f"SELECT *, coalesce(gap_ms <= {ECHO} AND delta_fme_bins <= 1, FALSE) AS link FROM ses",
    "chn": "SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (ORDER BY time_ms, line_no ROWS UNBOUNDED PRECEDING) AS chain FROM lnk",
    "best": "SELECT *, row_number() OVER (PARTITION BY chain ORDER BY snr_db DESC, time_ms, line_no) > 1 AS is_echo FROM chn",
    "ech": "SELECT *, link AS is_echo FROM lnk",
    "noe": "SELECT *, time_ms - lag(time_ms) OVER (ORDER BY time_ms, line_no) AS gap_ms2 FROM ech WHERE NOT is_echo",
    "ses2": f"SELECT *, CAST(sum(CASE WHEN gap_ms2 IS NULL OR gap_ms2 >= {GAP} THEN 1 ELSE 0 END) OVER (ORDER BY time_ms, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passage_id2 FROM noe",
    "clean": "SELECT * FROM ses2 WHERE fme_khz > 18",
}


def with_steps(select: str, last: str = "clean", more: dict[str, str] | None = None) -> str:
    """A query over the steps up to `last`, and more of its own."""
    names = list(_STEPS)
    steps = {n: _STEPS[n] for n in names[: names.index(last) + 1]} | (more or {})
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps.items()) + f"\n{select}"
