"""Counting individuals: species packets of passages, and a greedy tracker of their calls."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import padded_id
from ..schema import MixtureConfig, SplitConfig, TrackingConfig, struct
from ..scratch import stored, stored_bytes
from ..shipping import ship
from .density import fit
from .preprocess import KEY, TIE, TIME
from .species import label
from .tracking import Group, follow, follow_pieces, follow_with_intervals, whole_or_pieces


def value_packets(values: np.ndarray, counts: np.ndarray, config: SplitConfig) -> np.ndarray:
    """The packet of each distinct frequency of a passage: 0 for all of a short or uniform one, else the mixture's component."""
    if counts.sum() < config.min_chirps or np.allclose(values.min(), values.max()):
        return np.zeros(len(values), np.int64)
    model = fit(values, counts, MixtureConfig(scale=config.scale, prominence=config.prominence, min_distance_khz=config.distance_khz, max_components=config.max_components))
    return model.predict(values)


def packet_labels(fme_khz: np.ndarray, config: SplitConfig) -> np.ndarray:
    """The packet of each call of a passage."""
    values, place, counts = np.unique(fme_khz, return_inverse=True, return_counts=True)
    return value_packets(values, counts, config)[place]


#: Bytes of stored calls, about a million, that a task follows.
PIECE_BYTES = 4 << 20
#: Passages of a recording that are numbered by one task; what earlier ranges of so many hold comes from a row a range.
PASSAGES = 65_536
_TRACKED = f"{KEY} string, passage_id long, packet long, open_ord long, close_ord long, {TIME} long, {TIE} long, pos_fme int, fme_khz double, ici_ms double, packet_fme_khz double"


def _packets(pieces: DataFrame, split: SplitConfig) -> DataFrame:
    """(recording, passage, frequency) to packet and its median frequency, from counts of frequencies, which are whole bins."""
    counts = pieces.groupBy(KEY, "passage_id", "fme_khz").agg(F.count("*").alias("n"))
    lists = counts.groupBy(KEY, "passage_id").agg(F.sort_array(F.collect_list(F.struct("fme_khz", "n"))).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [value_packets(np.array([v["fme_khz"] for v in h]), np.array([v["n"] for v in h]), split).tolist() for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.list_(pa.int64()))], [*batch.schema.names, "packets"])

    ship(pieces.sparkSession)
    labelled = lists.mapInArrow(run, f"{KEY} string, passage_id long, h array<struct<fme_khz double, n long>>, packets array<long>")
    rows = labelled.select(KEY, "passage_id", F.explode(F.arrays_zip("h", "packets")).alias("p")).select(KEY, "passage_id", "p.h.fme_khz", "p.h.n", F.col("p.packets").alias("packet"))
    middles = rows.groupBy(KEY, "passage_id", "packet").agg(F.percentile("fme_khz", 0.5, F.col("n")).alias("packet_fme_khz"))
    return rows.drop("n").join(middles, [KEY, "passage_id", "packet"])


def track_calls(clean: DataFrame, split: SplitConfig = SplitConfig(), tracking: TrackingConfig = TrackingConfig(), passage: str = "passage_id2", tasks: int | None = None) -> DataFrame:
    """Every call with its packet and track, numbered inside its passage, which tracks never leave.

    Calls are dealt to tasks by ranges of (recording, passage, time). Passages that lie in one task, all but two a task, are
    followed there; the others piece by piece (tracking.follow_pieces), so a passage of any length is spread over tasks.
    `tasks` goes by the size of the calls, PIECE_BYTES a task, if not given; the calls are written once for it.
    """

    def call(g: Group) -> Group:
        labels = packet_labels(g["fme_khz"], split)
        n = len(labels)
        own, close, ici, middle = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.nan), np.zeros(n))
        for packet in np.unique(labels):
            rows = np.flatnonzero(labels == packet)
            track, place, ici[rows] = follow_with_intervals(g[TIME][rows].astype(float), g["pos_fme"][rows].astype(float), tracking)
            own[rows], close[rows] = track, place[track]
            middle[rows] = np.median(g["fme_khz"][rows])
        return {KEY: g[KEY], "passage_id": g["passage_id"], "packet": labels, "open_ord": own, "close_ord": close, TIME: g[TIME], TIE: g[TIE], "pos_fme": g["pos_fme"], "fme_khz": g["fme_khz"], "ici_ms": ici, "packet_fme_khz": middle}

    rows = clean.select(KEY, F.col(passage).cast("long").alias("passage_id"), TIME, TIE, F.col("pos_fme").cast("int").alias("pos_fme"), F.col("fme_khz").cast("double").alias("fme_khz"))
    rows = stored(rows)
    tasks = tasks or max(1, min(100_000, stored_bytes(rows) // PIECE_BYTES))
    columns = [f.name for f in struct(_TRACKED).fields]
    found = stored(whole_or_pieces(rows, [KEY, "passage_id"], [TIME, TIE], call, _TRACKED, tasks))
    if tasks == 1:
        return found.select(columns)
    pieces = found.filter("not whole").select(KEY, "passage_id", "piece", TIME, TIE, "pos_fme", "fme_khz")
    packets = stored(_packets(pieces, split))
    labelled = pieces.join(packets.drop("packet_fme_khz"), [KEY, "passage_id", "fme_khz"])
    middles = packets.select(KEY, "passage_id", "packet", "packet_fme_khz").distinct()
    over = follow_pieces(labelled, tracking).join(middles, [KEY, "passage_id", "packet"])
    return found.filter("whole").select(columns).unionByName(over.select(columns))


def tracks_of(calls: DataFrame, config: TrackingConfig = TrackingConfig()) -> DataFrame:
    """One row for each track of enough calls. Ids count all tracks opened, discarded ones too, over packets in order."""
    packet = [KEY, "passage_id", "packet"]
    opened = calls.groupBy(*packet).agg((F.max("open_ord") + 1).alias("_opened"))
    opened = opened.withColumn("_range", F.floor(F.col("passage_id") / PASSAGES))
    inside = Window.partitionBy(KEY, "_range").orderBy("passage_id", "packet").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = opened.groupBy(KEY, "_range").agg(F.sum("_opened").alias("n")).select(KEY, "_range", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("_ranges"))
    offsets = opened.join(ranges, [KEY, "_range"]).select(*packet, (F.coalesce(F.sum("_opened").over(inside), F.lit(0)) + F.col("_ranges")).alias("_before"))
    found = calls.groupBy(*packet, "open_ord", "close_ord").agg(
        F.min(TIME).alias("start_time_ms"), F.max(TIME).alias("end_time_ms"), F.count("*").cast("int").alias("n_chirps"), F.median("fme_khz").alias("fme_median_khz"),
        F.median("ici_ms").alias("ici_median_ms"), F.first("packet_fme_khz").alias("packet_fme_khz"),
    ).filter(F.col("n_chirps") >= config.min_chirps)
    return found.join(offsets, packet).select(
        KEY, padded_id("track-", F.col("_before") + F.col("open_ord") + 1, 4).alias("track_id"), "passage_id", F.concat_ws(":", "passage_id", "packet").alias("packet_id"), label(F.col("packet_fme_khz")).alias("passage_species"),
        "start_time_ms", "end_time_ms", "n_chirps", "fme_median_khz", "ici_median_ms", F.coalesce(F.col("ici_median_ms") < config.suspicious_ici_ms, F.lit(False)).alias("suspicious_short_ici"), "packet", "open_ord", "close_ord",
    )


def summary(tracks: DataFrame, clean: DataFrame) -> DataFrame:
    """One row a recording: passages, tracks, suspicious ones, tracks by species, tracks by number of calls."""
    base = clean.groupBy(KEY).agg(F.count_distinct("passage_id2").alias("n_passages_detected"))
    counts = tracks.groupBy(KEY, "passage_species", "n_chirps").agg(F.count("*").alias("n"), F.count_if("suspicious_short_ici").alias("s"))
    by = counts.groupBy(KEY, "passage_species").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by = by.groupBy(KEY).agg(F.sum("n").alias("n_individuals_estimated"), F.sum("s").alias("n_suspicious_short_ici_tracks"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("passage_species", "n")))).alias("individuals_by_species"))
    sizes = counts.groupBy(KEY, "n_chirps").agg(F.sum("n").alias("n")).groupBy(KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_chirps", "n")))).alias("tracks_by_n_chirps"))
    return base.join(by, KEY, "left").join(sizes, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_individuals_estimated", "n_suspicious_short_ici_tracks")})


@dataclass
class Counted:
    """Lazy tables of a count: calls with tracks, tracks, summary."""

    calls: DataFrame
    tracks: DataFrame
    summary: DataFrame


def count_individuals(clean: DataFrame, split: SplitConfig = SplitConfig(), tracking: TrackingConfig = TrackingConfig()) -> Counted:
    """Followed calls are stored, so uses of several of the tables follow them once."""
    calls = track_calls(clean, split, tracking)
    tracks = tracks_of(calls, tracking)
    return Counted(calls, tracks, summary(tracks, clean))


def tracker(module: str | Callable | None = None) -> Callable[[DataFrame], Counted]:
    """The counting function: ours, a callable, or count_individuals of a module named by its import path."""
    if module is None:
        return count_individuals
    return module if callable(module) else getattr(importlib.import_module(module), "count_individuals")
