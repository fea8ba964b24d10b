"""Clip projects: rows of imported clips, and edits of clip tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import fnv1a, padded_id
from ..schema import CLIP, struct
from .numbering import number_rows

#: Rows of a store in a block: clips meet rows by block, and inside one by row number.
BLOCK = 4096


def imported_detections(clips: DataFrame, stores: DataFrame, clamp: bool = False) -> DataFrame:
    """Rows of imported clips, moved by their clip's shift; clamp keeps times from falling below zero, as exports do.

    A clip is listed in the blocks of its store that its rows lie in, so a row meets only clips near it, however many a
    store has.
    """
    mine = clips.filter("kind = 'imported' and row_end > row_start").select(
        "clip_id", "store_id", "row_start", "row_end", (F.col("start_ms") - F.col("original_start_ms")).alias("_shift"), "species_name",
        F.explode(F.sequence(F.floor(F.col("row_start") / BLOCK), F.floor((F.col("row_end") - 1) / BLOCK))).alias("_block"),
    )
    placed = stores.withColumn("_block", F.floor(F.col("row_idx") / BLOCK))
    rows = mine.join(placed, ["store_id", "_block"]).filter((F.col("row_idx") >= F.col("row_start")) & (F.col("row_idx") < F.col("row_end")))
    time = F.floor(F.col("time_ms") + F.col("_shift") + 0.5)
    khz = lambda c: (F.col(c) * F.col("bin_khz")).alias(f"{c[4:]}_khz")
    return rows.select(
        F.concat("clip_id", F.lit("-import-"), (F.col("row_idx") - F.col("row_start")).cast("string")).alias("detection_id"), (F.greatest(F.lit(0), time) if clamp else time).cast("long").alias("time_ms"), "pos_fme", "pos_fi", "pos_ft",
        F.col("duration_windows").alias("pos_duration"), "snr_db", khz("pos_fme"), khz("pos_fi"), khz("pos_ft"), F.lit("imported").alias("individual_id"), "species_name", F.col("clip_id").alias("sequence_id"), F.lit(False).alias("is_echo"),
        F.lit(False).alias("is_noise"), F.col("clip_id").alias("source_clip_id"),
    )


def detections(clips: DataFrame, stores: DataFrame) -> DataFrame:
    """Detections of imported clips, numbered in order of time, clip and their own ids."""
    found = number_rows(imported_detections(clips, stores), ["time_ms", "source_clip_id", "detection_id"], "_number")
    return found.withColumn("detection_id", padded_id("det-", F.col("_number"), 6)).drop("_number")


def sensor_rows(found: DataFrame, recording_id: str = "project") -> DataFrame:
    """Detections as rows of a sensor log, times not below zero."""
    found = number_rows(found, ["time_ms", "detection_id"], "line_no", start=0)
    return found.select(F.lit(recording_id).alias("recording_id"), "line_no", F.greatest(F.lit(0), F.col("time_ms")).cast("long").alias("time_ms"), "pos_fme", "pos_fi", "pos_ft", F.col("pos_duration").alias("duration_windows"), "snr_db")


def import_as_clips(summaries: DataFrame, segments: DataFrame, store_id: str) -> DataFrame:
    """Clips of an imported log's segments: summaries of clip_summary() by segment, and their row ranges."""
    from .species import band

    rows = segments.join(summaries.withColumnRenamed("passage_id", "segment"), ["recording_id", "segment"])
    made = {
        "clip_id": F.concat(F.lit(f"{store_id}-"), F.col("segment").cast("string")), "kind": F.lit("imported"), "track_id": band(F.col("fme_median_khz")), "species_name": F.coalesce("species", F.lit("Indetermine")), "start_ms": F.col("first_ms"),
        "duration_ms": F.col("last_ms") - F.col("first_ms"), "store_id": F.lit(store_id), "row_start": F.col("row_start"), "row_end": F.col("row_end"), "original_start_ms": F.col("first_ms"), "ici_median_ms": F.col("ici_median_ms"),
    }
    return rows.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(CLIP).fields))


def _picked(clips: DataFrame, ids: DataFrame) -> DataFrame:
    return clips.join(ids, "clip_id", "left_semi")


def add_clips(clips: DataFrame, more: DataFrame) -> DataFrame:
    return clips.unionByName(more)


def delete_clips(clips: DataFrame, ids: DataFrame) -> DataFrame:
    return clips.join(ids, "clip_id", "left_anti")


def upsert_clips(clips: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed clips take the place of those of the same id; new ones are added."""
    return delete_clips(clips, changed.select("clip_id")).unionByName(changed)


def duplicates(clips: DataFrame, ids: DataFrame, suffix: str = "copy", shift_ms: float = 1000.0, seed_step: int = 1009) -> DataFrame:
    """Copies of the picked clips, a second later and with another seed."""
    name = lambda c: F.concat(c, F.lit(f"-{suffix}"))
    changes = {"clip_id": name("clip_id"), "individual_id": name("individual_id"), "sequence_id": name("sequence_id"), "start_ms": F.col("start_ms") + shift_ms, "seed": F.col("seed") + seed_step}
    return _picked(clips, ids).withColumns(changes)


def half_interval_copies(clips: DataFrame, ids: DataFrame) -> DataFrame:
    """Copies half an interval later: a second individual in the same rhythm."""
    late = F.when(F.col("kind") == "imported", F.col("ici_median_ms")).otherwise(F.col("ici_mean_ms")) / 2
    name = lambda c: F.concat(c, F.lit("-half"))
    seed = fnv1a(F.concat(F.col("seed").cast("string"), F.lit(":half:"), F.col("clip_id")))
    changes = {"clip_id": name("clip_id"), "individual_id": name("individual_id"), "sequence_id": name("sequence_id"), "start_ms": F.floor(F.col("start_ms") + late + 0.5).cast("double"), "seed": seed}
    return _picked(clips, ids).withColumns(changes)


def to_noise(clips: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with the picked generated clips turned into noise."""
    marked = clips.join(ids.select("clip_id").distinct().withColumn("_picked", F.lit(True)), "clip_id", "left")
    picked = F.col("_picked") & (F.col("kind") != "imported")
    pick = lambda new, old: F.when(picked, new).otherwise(F.col(old))
    changes: dict[str, Column] = {
        "clip_id": pick(F.concat("clip_id", F.lit("-noise")), "clip_id"), "sequence_id": pick(F.concat("sequence_id", F.lit("-noise")), "sequence_id"), "duration_ms": pick(F.least("duration_ms", F.greatest(F.col("ici_mean_ms") * 2, F.lit(500.0))), "duration_ms"),
        "snr_mean_db": pick(F.lit(20.0), "snr_mean_db"), "snr_std_db": pick(F.lit(1.5), "snr_std_db"), "echo_enabled": pick(F.lit(False), "echo_enabled"), "echo_probability": pick(F.lit(0.0), "echo_probability"),
        "seed": pick(fnv1a(F.concat(F.col("seed").cast("string"), F.lit(":noise:"), F.col("clip_id"))), "seed"), "kind": pick(F.lit("noise"), "kind"),
    }
    return marked.withColumns(changes).drop("_picked").select(*clips.columns)


def visible(clips: DataFrame, low: float, high: float) -> DataFrame:
    return clips.filter((F.col("start_ms") + F.col("duration_ms") >= low) & (F.col("start_ms") <= high))


def call_curve(points: int = 8) -> Column:
    """Array of the frequency of a call along its length, from start to end, for drawing."""
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda k: F.col("ft_khz") + (F.col("fi_khz") - F.col("ft_khz")) * F.exp(-3.5 * k / points))
