"""Writers: sensor logs, CSV tables, project documents, reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FFT_LENGTH, FFT_OVERLAP, SAMPLE_KHZ, SNR_MIN_DB, TRACK_CSV, TRUTH, struct

ROW = ("time_ms", "pos_fme", "pos_fi", "pos_ft", "duration_windows", "snr_db")


def sensor_header(count: int) -> list[str]:
    """The lines of a log before its rows. Fixed values of the sensor's format."""
    return [
        "DETECTDATA", f"FREQ_KHZ_ENREG {SAMPLE_KHZ}", f"LENFFT {FFT_LENGTH}", f"OVERLAP {FFT_OVERLAP}", f"SNRMIN {SNR_MIN_DB}", f"detectData_nbsig {count}", f"nbsig_detect {count}",
        "temps_ms_fin_prec 0", "RAW-ASCII 1", "time_ms posFME posFI posFT posDUREE SNRdB", "raw: uint32 uint8 uint8 uint8 uint8 uint8", "", "DATAASCII",
    ]


def write_sensor_text(rows: DataFrame, path: str) -> None:
    """One log of one recording as a folder of part files, which in their order are the log: header, then rows by time,
    every line ended by CR LF.

    Rows are dealt to tasks by ranges of (time, line), so a log of any size is written by many tasks; the header's lines
    are the smallest and open the first part. The header tells how many rows follow, so they are counted before.
    """
    header = rows.sparkSession.createDataFrame([(n, line) for n, line in enumerate(sensor_header(rows.count()))], "n long, value string")
    head = header.select(F.lit(0).alias("part"), "n", F.lit(0).cast("long").alias("tie"), "value")
    body = rows.select(F.lit(1).alias("part"), F.col("time_ms").alias("n"), F.col("line_no").alias("tie"), F.concat_ws(" ", *ROW).alias("value"))
    order = ("part", "n", "tie")
    head.unionByName(body).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_truth_csv(truth: DataFrame, path: str) -> None:
    truth.select(*(f.name for f in struct(TRUTH).fields)).write.mode("overwrite").option("header", True).csv(path)


def decimals(value: Column, digits: int = 6) -> Column:
    """A fixed number of digits; nan for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), "nan").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def tracks_csv_rows(tracks: DataFrame) -> DataFrame:
    """The columns of the tracks CSV as text: six digits, nan, lower-case booleans, in order of start, passage and track."""
    shown = {"fme_median_khz": decimals(F.col("fme_median_khz")), "ici_median_ms": decimals(F.col("ici_median_ms")), "suspicious_short_ici": F.lower(F.col("suspicious_short_ici").cast("string"))}
    return tracks.orderBy("start_time_ms", "passage_id", F.length("track_id"), "track_id").select(*(shown.get(f.name, F.col(f.name)).alias(f.name) for f in struct(TRACK_CSV).fields))


def write_tracks_csv(tracks: DataFrame, path: str) -> None:
    tracks_csv_rows(tracks).write.mode("overwrite").option("header", True).csv(path)


def write_evaluation(metrics: DataFrame, summary: DataFrame, assignments: DataFrame, folder: str, dataset: str) -> list[str]:
    """Three CSV folders; booleans as True and False, nulls as nan."""
    out = []
    for name, table in (("metrics", metrics), ("summary", summary), ("assignments", assignments)):
        shown = [F.initcap(F.col(f"`{c}`").cast("string")).alias(c) if t == "boolean" else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in table.dtypes]
        path = f"{folder}/{dataset}_{name}"
        table.select(*shown).write.mode("overwrite").option("header", True).csv(path)
        out.append(path)
    return out


def write_detection_truth(detections: DataFrame, path: str) -> None:
    """Ground truth of simulated detections, with the column names and quotes of that format."""
    text = lambda c: F.lower(F.col(c).cast("string"))
    rows = detections.orderBy("detection_id").select("detection_id", "time_ms", F.col("individual_id").alias("individu_id"), F.col("species_name").alias("espèce"), text("is_echo").alias("est_echo"), text("is_noise").alias("est_bruit"), "sequence_id")
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_project(projects: DataFrame, path: str) -> None:
    """A JSON document a project."""
    projects.select(F.to_json(F.struct(*projects.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_project_table(projects: DataFrame, path: str) -> None:
    projects.write.mode("overwrite").parquet(path)


def write_text(path: str, text: str) -> None:
    """A report on the driver's own disk; folders are made."""
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding="utf-8")


Figures = list[tuple[str, object]]


def figures_text(title: str, sections: dict[str, Figures]) -> str:
    """A report: a title, then the named figures of each section, one a line."""
    lines = [f"# {title}"]
    for section, figures in sections.items():
        wide = max((len(name) for name, _ in figures), default=0)
        lines += ["", f"## {section}", *(f"{name.ljust(wide)} = {_shown(value)}" for name, value in figures)]
    return "\n".join(lines)


def _shown(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.6g}"
    return "none" if value is None or value == [] else ", ".join(map(_shown, value)) if isinstance(value, (list, tuple)) else str(value)


def counting_report(summary: DataFrame) -> str:
    """Figures of each recording; a row a recording comes to the driver. Tracks are a table of their own (write_track_lines)."""
    sections: dict[str, Figures] = {}
    for row in summary.orderBy("recording_id").collect():
        own = [("passages", row["n_passages_detected"]), ("individuals", row["n_individuals_estimated"]), ("with suspiciously short intervals", row["n_suspicious_short_ici_tracks"])]
        own += [(f"individuals of {name}", n) for name, n in sorted((row["individuals_by_species"] or {}).items())]
        sections[row["recording_id"]] = own + [(f"tracks of {size} calls", n) for size, n in sorted((row["tracks_by_n_chirps"] or {}).items())]
    return figures_text("Individuals counted", sections or {"no recording": []})


def write_track_lines(tracks: DataFrame, path: str) -> None:
    """A line a track in order of recording and number, as text part files that Spark writes."""
    shown = F.format_string(
        "%s %s passage %d, %s: %d calls from %d to %d ms, %s kHz every %s ms%s", "recording_id", "track_id", "passage_id", "passage_species", "n_chirps", "start_time_ms", "end_time_ms", decimals(F.col("fme_median_khz"), 2), decimals(F.col("ici_median_ms"), 1),
        F.when(F.col("suspicious_short_ici"), " (short)").otherwise(""),
    )
    tracks.orderBy("recording_id", F.length("track_id"), "track_id").select(shown.alias("value")).write.mode("overwrite").text(path)


def clustering_report(settings: Figures, counters: dict, clusters: list[dict], thresholds: list[float], peaks: list[float]) -> str:
    """Settings, counters of the stages, and the figures of each cluster."""
    total = sum(c["n"] for c in clusters) or 1
    sections = {"settings": settings, "counters": list(counters.items()), "mixture": [("components", len(clusters)), ("peaks in kHz", peaks), ("borders in kHz", thresholds)]}
    for c in clusters:
        sections[f"cluster {c['label']}"] = [("calls", c["n"]), ("share", c["n"] / total), ("median kHz", c["median"]), ("mean kHz", c["mean"]), ("sigma kHz", c["sigma"]), ("weight", c["weight"]), ("species", c["species"])]
    return figures_text("Mixture of frequencies", sections)


def zone_report(path: str, low: float, high: float, n_clean: int, zone: dict, top: list[dict]) -> str:
    """Figures of a band and of its largest sequences."""
    if not zone["n"]:
        raise ValueError("no detection lies in the band")
    own = [("log", path), ("low kHz", low), ("high kHz", high), ("detections but artefacts", n_clean), ("share in the band", zone["n"] / n_clean), ("hours from first to last", (zone["last_ms"] - zone["first_ms"]) / 3_600_000)]
    largest = [(f"passage {t['passage_id']}", f"{t['n']} calls in {t['end_ms'] - t['start_ms']} ms, {_shown(t['fme_median'])} kHz, {_shown(t['snr_median'])} dB") for t in top]
    return figures_text("Frequency band", {"band": own, "figures": list(zone.items()), "largest sequences": largest})
