"""A greedy tracker of calls that can stop at any call and go on elsewhere, over passages of any length."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TrackingConfig, struct
from ..scratch import scratch_folder, stored
from ..shipping import ship
from .numbering import number_rows
from .preprocess import KEY, TIE, TIME


Group = dict[str, np.ndarray]


class Tally:
    """Values with counts and their median, which moves by a step or two when a value comes in."""

    __slots__ = ("values", "counts", "total", "at", "before")

    def __init__(self, values: list | None = None, counts: list | None = None):
        self.values, self.counts = list(values or []), list(counts or [])
        self.total, self.at, self.before = sum(self.counts), 0, 0
        self._settle()

    def add(self, value: float) -> None:
        place = bisect_left(self.values, value)
        if place == len(self.values) or self.values[place] != value:
            self.values.insert(place, value)
            self.counts.insert(place, 0)
            self.at += place <= self.at < len(self.values) - 1 and self.total > 0
        self.counts[place] += 1
        self.before += place < self.at
        self.total += 1
        self._settle()

    def _settle(self) -> None:
        """Move to the lower middle."""
        if not self.total:
            return
        middle = (self.total - 1) // 2
        while self.before > middle:
            self.at -= 1
            self.before -= self.counts[self.at]
        while self.before + self.counts[self.at] <= middle:
            self.before += self.counts[self.at]
            self.at += 1

    def median(self) -> float:
        low = self.values[self.at]
        if self.total % 2 or self.before + self.counts[self.at] > self.total // 2:
            return low
        return (low + self.values[self.at + 1]) / 2


class Track:
    """An open track: its number in order of opening, its last call, and its intervals and frequencies so far with their
    medians and the tolerance for its next interval."""

    __slots__ = ("number", "last", "icis", "bins", "ici", "allowed", "middle")

    def __init__(self, number: int, config: TrackingConfig, last: float = 0.0, icis: Tally | None = None, bins: Tally | None = None):
        self.number, self.last, self.icis, self.bins = number, last, icis or Tally(), bins or Tally()
        self.settle(config)

    def settle(self, config: TrackingConfig) -> None:
        self.ici = self.icis.median() if self.icis.total else config.bootstrap_ici_ms
        self.allowed = max(1.0, self.ici * config.ici_tolerance)
        self.middle = self.bins.median() if self.bins.total else 0.0


class Follower:
    """The tracker's state between two calls.

    Calls come in time order. A track closes when its silence exceeds expiry_icis of its own interval. A call joins the
    open track that it fits best in time and frequency, the first opened of equals, or opens one.

    A few open tracks are asked one by one. What a call asks of more of them is held in arrays, in order of opening, and asked
    of all at once, so a call in a crowd costs little more than any other. Places without a track are silent for ever. A track
    that has expired can't be joined; it is put into `closed`, as (number, last call, interval), at the latest when room is needed.
    """

    #: Tracks that are asked one by one.
    FEW = 10

    def __init__(self, config: TrackingConfig, opened: int = 0, tracks: list[Track] | None = None):
        self.config, self.opened, self.tracks = config, opened, tracks or []
        self.scale, self.limit = max(1.0, config.fme_tolerance_bins), config.expiry_icis
        self.closed: list[tuple[int, float, float]] = []
        self._lay()

    def _lay(self) -> None:
        self.room = 0
        if len(self.tracks) <= self.FEW:
            return
        self.room = 16
        while self.room < 2 * len(self.tracks):
            self.room *= 2
        self.last, self.ici, self.allowed, self.bins = np.full(self.room, -np.inf), np.ones(self.room), np.ones(self.room), np.zeros(self.room)
        self.silence, self.late, self.away, self.score, self.part = np.empty((5, self.room))
        self.now, self.heard, self.scales = np.zeros(()), np.zeros(()), np.array(self.scale)
        for place, track in enumerate(self.tracks):
            self.last[place], self.ici[place], self.allowed[place], self.bins[place] = track.last, track.ici, track.allowed, track.middle

    def close(self, time: float) -> None:
        """Let go of the tracks that have expired at a time."""
        gone = [t for t in self.tracks if time - t.last > self.limit * t.ici]
        if gone:
            self.closed += [(t.number, t.last, t.ici) for t in gone]
            self.tracks = [t for t in self.tracks if time - t.last <= self.limit * t.ici]

    def _one_by_one(self, time: float, bins: float) -> int:
        """The place of the track that a call joins, -1 for none."""
        best, least, limit, tolerance, expired = -1, np.inf, self.limit, self.config.fme_tolerance_bins, False
        for place, track in enumerate(self.tracks):
            silence, ici = time - track.last, track.ici
            if silence > limit * ici:
                expired = True
                continue
            late, away = abs(silence - ici), abs(bins - track.middle)
            if silence > 0 and late <= track.allowed and away <= tolerance:
                score = late / track.allowed + away / self.scale
                if score < least:
                    best, least = place, score
        if expired:
            found = self.tracks[best] if best >= 0 else None
            self.close(time)
            best = self.tracks.index(found) if found else -1
        return best

    def _at_once(self, time: float, bins: float) -> int:
        """What _one_by_one() gives, but for expired tracks, which stay."""
        silence, late, away, score, config = self.silence, self.late, self.away, self.score, self.config
        self.now[()], self.heard[()] = time, bins
        np.subtract(self.now, self.last, silence)
        np.subtract(silence, self.ici, late)
        np.absolute(late, late)
        np.divide(late, self.allowed, score)
        np.subtract(self.heard, self.bins, away)
        np.absolute(away, away)
        np.divide(away, self.scales, self.part)
        np.add(score, self.part, score)
        best = int(score.argmin())
        if score[best] > 2.0:  # what fits has 1 at most for its time and 1 for its frequency
            return -1
        if 0 < silence[best] <= self.limit * self.ici[best] and late[best] <= self.allowed[best] and away[best] <= config.fme_tolerance_bins:
            return best
        fits = np.flatnonzero((silence > 0) & (late <= self.allowed) & (away <= config.fme_tolerance_bins) & (silence <= self.limit * self.ici))
        return int(fits[score[fits].argmin()]) if len(fits) else -1

    def call(self, time: float, bins: float) -> tuple[int, float]:
        """The number of the call's track and the interval since its last call (nan for a first one)."""
        place, full = self._at_once(time, bins) if self.room else self._one_by_one(time, bins), False
        if place >= 0:
            track = self.tracks[place]
            interval = time - track.last
            track.icis.add(interval)
        else:
            full = len(self.tracks) == (self.room or self.FEW)
            if full:
                self.close(time)
            track, interval, place = Track(self.opened, self.config), np.nan, len(self.tracks)
            self.opened += 1
            self.tracks.append(track)
        track.bins.add(bins)
        track.last = time
        track.settle(self.config)
        if full:
            self._lay()
        elif self.room:
            self.last[place], self.ici[place], self.allowed[place], self.bins[place] = time, track.ici, track.allowed, track.middle
        return track.number, interval


def due(last, ici, config: TrackingConfig):
    """The first time, times being whole numbers, at which a track is closed."""
    return last + np.floor(config.expiry_icis * ici) + 1


def follow(times: np.ndarray, bins: np.ndarray, config: TrackingConfig) -> tuple[np.ndarray, np.ndarray]:
    """(track of each call in order of opening, place of each track in order of closing); open tracks close last."""
    return follow_with_intervals(times, bins, config)[:2]


def follow_with_intervals(times: np.ndarray, bins: np.ndarray, config: TrackingConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What follow() gives, and each call's interval since the call before in its track (nan for a first one).

    Bands of frequencies that can't share tracks (follow_pieces) are followed one after another, each asking its own tracks alone.
    """
    values = np.unique(bins)
    band = np.searchsorted(values[1:][np.diff(values) > config.fme_tolerance_bins], bins, "right")
    own, icis, ends = np.zeros(len(times), np.int64), np.full(len(times), np.nan), []
    for b in range(band.max() + 1 if len(band) else 0):
        rows, follower = np.flatnonzero(band == b), Follower(config)
        found = [follower.call(t, f) for t, f in zip(times[rows].tolist(), bins[rows].tolist())]
        own[rows], icis[rows] = [f[0] + len(ends) for f in found], [f[1] for f in found]
        ends += [due(last, ici, config) for _, last, ici in sorted(follower.closed + [(t.number, t.last, t.ici) for t in follower.tracks])]
    first = np.unique(own, return_index=True)[1]
    opening = np.empty(len(ends), np.int64)
    opening[np.argsort(first, kind="stable")] = np.arange(len(ends))
    place = np.empty(len(ends), np.int64)
    place[np.lexsort((opening, np.searchsorted(times, ends)))] = np.arange(len(ends))
    by_opening = np.empty(len(ends), np.int64)
    by_opening[opening] = place
    return opening[own], by_opening, icis


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in struct(schema).fields]


#: Tracks of a piece of work that are handed on together.
BATCH = 20_000


def whole_or_pieces(rows: DataFrame, keys: list[str], order: list[str], call: Callable[[Group], Group], schema: str, tasks: int) -> DataFrame:
    """call for each run of equal keys that lies in one task; rows of the last run of a task and of the first of all but the
    first, which may go on in their neighbours, as they are (whole: false; piece: the task's number).

    Rows are dealt to tasks by ranges of (keys, order), so a run of any length is spread over them. A task holds one run at most.
    Columns are those of schema; what a row has of them is kept in a piece, the others are null.
    """
    ship(rows.sparkSession)
    kinds = [*_arrow(schema), ("whole", pa.bool_()), ("piece", pa.int64())]
    given = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs, held, current = TaskContext.get().partitionId(), 0, [], None

        def piece(part: pa.RecordBatch) -> pa.RecordBatch:
            n = part.num_rows
            fixed = {"whole": pa.array([False] * n), "piece": pa.array([task] * n, pa.int64())}
            return pa.RecordBatch.from_arrays([fixed[c] if c in fixed else part.column(c) if c in given else pa.nulls(n, k) for c, k in kinds], [c for c, _ in kinds])

        def finished(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = pa.Table.from_batches(parts)
            found = call({c: columns.column(c).to_numpy() for c in given})
            n = len(found[kinds[0][0]])
            fixed = {"whole": pa.array([True] * n), "piece": pa.array([task] * n, pa.int64())}
            return pa.RecordBatch.from_arrays([fixed[c] if c in fixed else pa.array(found[c], k, from_pandas=True) for c, k in kinds], [c for c, _ in kinds])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]]) if batch.num_rows else [0]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in columns)
                if key != current:
                    if held:
                        done.append(finished(held))
                    current, runs, held = key, runs + 1, []
                if runs == 1 and task:
                    yield piece(batch.slice(a, b - a))
                else:
                    held.append(batch.slice(a, b - a))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if tasks > 1:
            yield from map(piece, held)
        elif held:
            yield from pa.Table.from_batches([finished(held)]).combine_chunks().to_batches()

    spread = rows.withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
    sorting = [*keys, *order, "_place"]
    return spread.repartitionByRange(tasks, *sorting).sortWithinPartitions(*sorting).drop("_place").mapInArrow(run, f"{schema}, whole boolean, piece long")


_GROUP = [KEY, "passage_id", "packet"]
_STEP = (
    f"kind string, band long, track long, {TIME} long, {TIE} long, pos_fme int, fme_khz double, ici_ms double,"
    " last double, ici double, tallies string, opened long"
)
_CALLS = f"{KEY} string, passage_id long, packet long, open_ord long, close_ord long, {TIME} long, {TIE} long, pos_fme int, fme_khz double, ici_ms double"


def _round(config: TrackingConfig):
    """One piece of each band: its open tracks from the piece before come first, then its calls."""
    kinds = _arrow(_STEP)

    def rows(kind: str, band: int, more: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(more.values())))
        given = {"kind": pa.array([kind] * n), "band": pa.array([band] * n, pa.int64())} | {c: v if isinstance(v, pa.Array) else pa.array(v, dict(kinds)[c], from_pandas=True) for c, v in more.items()}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, t) for c, t in kinds], [c for c, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, follower, held = None, None, []

        def closed() -> pa.RecordBatch:
            number, last, ici = zip(*follower.closed)
            follower.closed = []
            return rows("closed", band, {"track": number, "last": last, "ici": ici})

        def leave() -> Iterator[pa.RecordBatch]:
            """The band's tracks at the end of its piece; a row without a track tells how many there have been."""
            t = follower.tracks
            if follower.closed:
                yield closed()
            tallies = [json.dumps([k.icis.values, k.icis.counts, k.bins.values, k.bins.counts]) for k in t]
            yield rows("open", band, {"track": [-1, *(k.number for k in t)], "last": [None, *(k.last for k in t)], "ici": [None, *(k.ici for k in t)], "tallies": [None, *tallies], "opened": [follower.opened] * (len(t) + 1)})

        for batch in batches:
            at, state = batch.column("band").to_numpy(), batch.column(TIME).is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (state[1:] != state[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if at[a] != band:
                    if band is not None:
                        follower = follower or _carried(held, config)
                        yield from leave()
                    band, follower, held = int(at[a]), None, []
                if state[a]:
                    held += part.to_pylist()
                    continue
                if follower is None:
                    follower = _carried(held, config)
                found = [follower.call(t, b) for t, b in zip(part.column(TIME).to_numpy().astype(float).tolist(), part.column("pos_fme").to_numpy().astype(float).tolist())]
                yield rows("call", band, {"track": np.array([f[0] for f in found], np.int64), "ici_ms": np.array([f[1] for f in found])} | {c: part.column(c) for c in (TIME, TIE, "pos_fme", "fme_khz")})
                if len(follower.closed) >= BATCH:
                    yield closed()
        if band is not None:
            follower = follower or _carried(held, config)
            yield from leave()

    return run


def _carried(held: list[dict], config: TrackingConfig) -> Follower:
    """A tracker that goes on where the piece before ended, from its rows (leave()). Tallies are text, as Spark measures a batch
    for Python again with each row, which takes long where a column holds lists."""
    tracks = []
    for r in held:
        if r["track"] >= 0:
            icis, ici_counts, bins, bin_counts = json.loads(r["tallies"])
            tracks.append(Track(r["track"], config, r["last"], Tally(icis, ici_counts), Tally(bins, bin_counts)))
    return Follower(config, held[0]["opened"] if held else 0, tracks)


def follow_pieces(pieces: DataFrame, config: TrackingConfig) -> DataFrame:
    """Calls of packets that lie in several pieces, with their track, its place in order of closing, and the interval.

    pieces: _GROUP, piece, time, line, pos_fme, fme_khz. The tracker can't know a piece's beginning before the piece before
    has ended, so pieces of a packet are followed in rounds, all packets side by side; what goes from one round to the
    next is each open track's last call and the counts of its intervals and frequencies.

    A packet is cut into bands, where its frequencies leave a step beyond the tolerance: as a track's median lies among its
    own calls, no call beyond such a step can join it, and a track's end depends on time alone. So bands are followed side
    by side too, and a task's work in a round is one band of one piece. Orders of opening and closing, which go over all
    bands of a packet, are worked out afterwards from each track's first call and end (_orders).
    """
    spark = pieces.sparkSession
    ship(spark)
    seen = stored(pieces.groupBy(*_GROUP, "piece", "pos_fme").agg(F.max(TIME).alias("until")))  # a row a frequency of a packet's piece
    runs = seen.select(KEY, "passage_id", "piece").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(KEY, "passage_id").orderBy("piece")))
    values = Window.partitionBy(*_GROUP).orderBy("pos_fme")
    bands = seen.select(*_GROUP, "pos_fme").distinct().withColumn("_step", (F.col("pos_fme") - F.lag("pos_fme").over(values) > config.fme_tolerance_bins).cast("int"))
    bands = bands.withColumn("_in", F.coalesce(F.sum("_step").over(values), F.lit(0)))
    bands = stored(bands.select(*_GROUP, "pos_fme", F.dense_rank().over(Window.orderBy(*_GROUP, "_in")).cast("long").alias("band"), F.dense_rank().over(Window.orderBy(*_GROUP)).cast("long").alias("pack")))
    many = bands.agg(F.max("band")).first()[0]
    if many is None:
        return spark.createDataFrame([], _CALLS)
    parts = min(many, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # two runs a task at most, and their packets and frequencies
    ranked = pieces.join(F.broadcast(runs), [KEY, "passage_id", "piece"]).join(F.broadcast(bands), [*_GROUP, "pos_fme"])
    ranked = stored(ranked.select("rank", "band", TIME, TIE, "pos_fme", "fme_khz"), "rank")
    rounds = [r["rank"] for r in runs.select("rank").distinct().orderBy("rank").collect()]
    columns, folder = [f.name for f in struct(_STEP).fields], f"{scratch_folder(spark)}/rounds"
    state = spark.createDataFrame([], _STEP)
    for number in rounds:
        calls = ranked.filter(F.col("rank") == number).withColumn("kind", F.lit("call"))
        both = state.unionByName(calls.select(*(F.col(c) if c in calls.columns else F.lit(None).cast(struct(_STEP)[c].dataType).alias(c) for c in columns)))
        dealt = both.repartitionById(parts, (F.col("band") % parts).cast("int")).sortWithinPartitions("band", F.col(TIME).isNotNull(), TIME, TIE, "track")
        dealt.mapInArrow(_round(config), _STEP).write.partitionBy("kind").parquet(f"{folder}/rank={number}")
        state = spark.read.schema(_STEP).parquet(f"{folder}/rank={number}").filter("kind = 'open'")
    steps = spark.read.schema(f"{_STEP}, rank int").parquet(folder)
    packs = seen.join(bands, [*_GROUP, "pos_fme"])
    until = packs.join(runs, [KEY, "passage_id", "piece"]).groupBy("pack", "rank").agg(F.max("until").alias("until"))
    orders = _orders(steps, packs.select("pack", "band").distinct(), until, config, rounds[-1])
    names = bands.select(*_GROUP, "pack").distinct()
    return steps.filter("kind = 'call'").join(orders, ["band", "track"]).join(F.broadcast(names), "pack").select([f.name for f in struct(_CALLS).fields])


def _orders(steps: DataFrame, packs: DataFrame, until: DataFrame, config: TrackingConfig, last: int) -> DataFrame:
    """(band, track) to packet (pack), and its places there in order of opening and of closing.

    steps: what the rounds gave; packs: each band's packet; until: the last call of each packet's piece. A track closes with
    the packet's first call from a certain time on, before the next tracks that this call closes and that opened later; the
    piece of that call is known from `until`, the call by a window over the piece's times. Those that nothing closes come last.
    """
    calls = steps.filter("kind = 'call'").join(F.broadcast(packs), "band")
    first = calls.filter("ici_ms IS NULL").select("pack", TIME, TIE, "band", "track")
    opened = number_rows(first, ["pack", TIME, TIE, "band", "track"], "open_ord", 0)
    base = opened.groupBy("pack").agg(F.min("open_ord").alias("_base"))
    opened = opened.join(F.broadcast(base), "pack").withColumn("open_ord", F.col("open_ord") - F.col("_base"))
    ends = steps.filter(F.col("kind").isin("closed") | ((F.col("kind") == "open") & (F.col("rank") == last) & (F.col("track") >= 0)))
    ends = ends.select("band", "track", (F.col("last") + F.floor(F.lit(float(config.expiry_icis)) * F.col("ici")) + 1).cast("long").alias("due"))
    tracks = opened.select("pack", "band", "track", "open_ord", "_base").join(ends, ["band", "track"])
    spans = until.withColumn("_before", F.lag("until").over(Window.partitionBy("pack").orderBy("rank"))).withColumnRenamed("pack", "_pack")
    inside = (F.col("pack") == F.col("_pack")) & (F.col("due") <= F.col("until")) & (F.col("_before").isNull() | (F.col("due") > F.col("_before")))
    tracks = tracks.join(F.broadcast(spans), inside, "left").drop("_pack", "until", "_before")
    times = calls.select("pack", "rank", TIME).distinct().withColumn("closing", F.col(TIME))
    both = tracks.withColumn(TIME, F.col("due")).unionByName(times, allowMissingColumns=True)
    back = Window.partitionBy("pack", "rank").orderBy(F.desc(TIME), F.col("track").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.filter("rank IS NOT NULL").withColumn("closing", F.last("closing", ignorenulls=True).over(back)).unionByName(tracks.filter("rank IS NULL"), allowMissingColumns=True)
    closed = both.filter("track IS NOT NULL").withColumn("_never", F.col("closing").isNull())
    closed = number_rows(closed.select("pack", "_never", "closing", "open_ord", "band", "track", "_base"), ["pack", "_never", "closing", "open_ord"], "close_ord", 0)
    return closed.select("pack", "band", "track", "open_ord", (F.col("close_ord") - F.col("_base")).alias("close_ord"))
