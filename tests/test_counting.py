import numpy as np
import pytest

from echoloom.operators import counting, density, tracking, validation
from echoloom.operators.preprocess import preprocess
from echoloom.schema import DETECTION, MixtureConfig, PreprocessConfig, SplitConfig, TrackingConfig


def count(spark, rows, split=SplitConfig(), tracking=TrackingConfig()):
    frame = spark.createDataFrame([("r", n, *r) for n, r in enumerate(rows)], DETECTION)
    clean = preprocess(frame, PreprocessConfig(strategy="best_snr", passage_gap_ms=250)).clean
    done = counting.count_individuals(clean, split, tracking)
    return done.tracks.orderBy("track_id").collect(), done.summary.first()


def call(t, fme=97):
    return (t, fme, fme + 3, fme - 3, 6, 28)


def test_regular_calls_are_one_track(spark):
    tracks, summary = count(spark, [call(i * 100) for i in range(12)])
    assert [t.n_chirps for t in tracks] == [12] and not tracks[0].suspicious_short_ici
    assert tracks[0].ici_median_ms == 100 and summary.n_individuals_estimated == 1 and summary.individuals_by_species == {"Pipistrellus kuhlii": 1}


def test_two_species_are_split(spark):
    rows = [call(i * 100) for i in range(18)] + [call(i * 100 + 45, 136) for i in range(18)]
    tracks, _ = count(spark, rows, SplitConfig(15, 4, 0.55, 0.01, 5.0))
    assert sorted(t.passage_species for t in tracks) == ["Pipistrellus kuhlii", "Pipistrellus pygmaeus"]


def test_short_tracks_are_dropped_but_numbered(spark):
    tracks, _ = count(spark, [call(0), call(50, 180), call(100), call(180, 180), call(200)])
    assert [(t.track_id, t.n_chirps) for t in tracks] == [("track-0001", 3)]


def test_short_intervals_are_suspicious(spark):
    tracks, _ = count(spark, [call(i * 35) for i in range(8)], tracking=TrackingConfig(bootstrap_ici_ms=35))
    assert [t.suspicious_short_ici for t in tracks] == [True]


def test_two_rhythms(spark):
    first, second = [0], [0]
    for k in range(29):
        first.append(first[-1] + 100 + [-10, 0, 10, 5, -5][k % 5])
    for k in range(24):
        second.append(second[-1] + 130 + [-13, 0, 13, 7, -7][k % 5])
    tracks, _ = count(spark, [call(t) for t in first] + [call(t + 37, 99) for t in second], SplitConfig(min_chirps=1000), TrackingConfig(ici_tolerance=0.35, fme_tolerance_bins=1))
    assert sorted(t.n_chirps for t in tracks) == [25, 30]


def plain_tracker(times, bins, c=TrackingConfig()):
    """The tracker restated without any of its shortcuts."""
    open_, closed, out, n = [], [], [], 0
    for t, b in zip(times, bins):
        ici = lambda k: np.median(np.diff(k["t"])) if len(k["t"]) > 1 else c.bootstrap_ici_ms
        closed += [k for k in open_ if t - k["t"][-1] > c.expiry_icis * ici(k)]
        open_ = [k for k in open_ if t - k["t"][-1] <= c.expiry_icis * ici(k)]
        fits = []
        for k in open_:
            d, tol = t - k["t"][-1], max(1.0, ici(k) * c.ici_tolerance)
            late, away = abs(d - ici(k)), abs(b - np.median(k["b"]))
            if d > 0 and late <= tol and away <= c.fme_tolerance_bins:
                fits.append((late / tol + away / max(1.0, c.fme_tolerance_bins), k))
        best = min(fits, key=lambda f: f[0])[1] if fits else None
        if best is None:
            best = {"n": n, "t": [], "b": []}
            n += 1
            open_.append(best)
        best["t"].append(t)
        best["b"].append(b)
        out.append(best["n"])
    return out, [k["n"] for k in closed + open_]


@pytest.mark.parametrize("seed", range(5))
def test_tracker_against_a_plain_version(seed):
    rng = np.random.default_rng(seed)
    times = np.sort(rng.integers(0, 8000, 300)).astype(float)
    bins = rng.integers(94, 104, 300).astype(float)
    own, place = counting.follow(times, bins, TrackingConfig())
    plain, order = plain_tracker(times, bins)
    assert own.tolist() == plain and np.argsort(place).tolist() == order


def test_tally():
    rng = np.random.default_rng(1)
    for top in (3, 50, 10_000):
        tally, seen = tracking.Tally(), []
        for v in rng.integers(0, top, 400).tolist():
            tally.add(v)
            seen.append(v)
            assert tally.median() == np.median(seen)
        again = tracking.Tally(tally.values, tally.counts)
        again.add(5)
        assert again.median() == np.median([*seen, 5])


def plain_calls(rows, split, config):
    """(time, line): packet, track, place of closing, interval of each call of one passage, from its arrays whole."""
    times, bins, khz = (np.array([r[k] for r in rows], float) for k in (0, 2, 3))
    out = {}
    labels = counting.packet_labels(khz, split)
    for packet in np.unique(labels):
        at = np.flatnonzero(labels == packet)
        own, place = counting.follow(times[at], bins[at], config)
        for k, i in enumerate(at):
            before = [j for j in at[:k] if own[np.flatnonzero(at == j)[0]] == own[k]][-1:] if k < 400 else None
            ici = None if before is None else (times[i] - times[before[0]] if before else np.nan)
            out[rows[i][0], rows[i][1]] = (packet, own[k], place[own[k]], ici, np.median(khz[at]))
    return out


@pytest.mark.parametrize("tasks", [9, 2, None])
def test_passages_over_several_tasks(spark, tasks):
    """One passage of 12,000 calls of two species over many tasks, among short ones, is followed as in one."""
    rng = np.random.default_rng(9)
    rows, time = [], 0
    for passage, n in ((1, 40), (2, 12_000), (3, 7), (4, 300), (5, 1)):
        for _ in range(n):
            time += int(rng.integers(1, 60))
            rows.append(("r", passage, time, len(rows), int(rng.choice([97, 98, 140, 141]) + rng.integers(-1, 2))))
        time += 5000
    frame = spark.createDataFrame([(*r, r[4] * 0.390625) for r in rows], "recording_id string, passage_id2 long, time_ms long, line_no long, pos_fme int, fme_khz double").repartition(3)
    split, config = SplitConfig(15, 4, 0.55, 0.01, 5.0), TrackingConfig()
    found = counting.track_calls(frame, split, config, tasks=tasks).collect()
    assert len(found) == len(rows)
    for passage in range(1, 6):
        want = plain_calls([(r[2], r[3], r[4], r[4] * 0.390625) for r in rows if r[1] == passage], split, config)
        got = {(r.time_ms, r.line_no): r for r in found if r.passage_id == passage}
        assert got.keys() == want.keys()
        for key, (packet, own, close, ici, middle) in want.items():
            r = got[key]
            assert (r.packet, r.open_ord, r.close_ord, r.packet_fme_khz) == (packet, own, close, middle)
            assert ici is None or (r.ici_ms is None if np.isnan(ici) else r.ici_ms == ici)


def test_bands_of_pieces_are_followed_side_by_side(spark, monkeypatch):
    """Bands of far frequencies are groups of their own in each round; tracks, both orders and intervals as in one run over all.

    Two packets, a band that is not in every piece, callers that go on through all pieces, a crowd at one time that needs more
    room, and uneven tolerances."""
    bands, plain = [], tracking._orders
    monkeypatch.setattr(tracking, "_orders", lambda steps, packs, *rest: bands.append(sorted((r["pack"], r["band"]) for r in packs.collect())) or plain(steps, packs, *rest))
    rng, config = np.random.default_rng(3), TrackingConfig(ici_tolerance=0.37, fme_tolerance_bins=2.5, expiry_icis=2.3, bootstrap_ici_ms=33.3)
    rows = [(7, int(t), int(b)) for t, b in zip(rng.integers(0, 60_000, 3000), rng.integers(90, 99, 3000))]
    rows += [(7, int(t), 60) for t in rng.integers(0, 20_000, 300)] + [(7, 12_345, int(b)) for b in rng.integers(88, 92, 60)] + [(8, int(t), int(b)) for t, b in zip(rng.integers(0, 60_000, 500), rng.choice([50, 53, 57], 500))]
    rows += [(7, 33 * k + int(rng.integers(-9, 10)) + 13 * caller, 120 + 3 * caller) for k in range(1800) for caller in range(2)]
    rows = [("r", 1, packet, t // 15_000 + 2, t, n, b, b * 0.390625) for n, (packet, t, b) in enumerate(sorted(rows, key=lambda r: r[1]))]
    frame = spark.createDataFrame(rows, "recording_id string, passage_id long, packet long, piece long, time_ms long, line_no long, pos_fme int, fme_khz double").repartition(3)
    found = {(r.packet, r.line_no): r for r in tracking.follow_pieces(frame, config).collect()}
    assert len(found) == len(rows) and bands == [[(1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 6), (2, 7)]]
    for packet in {r[2] for r in rows}:
        at = [r for r in rows if r[2] == packet]
        times, bins = np.array([float(r[4]) for r in at]), np.array([float(r[6]) for r in at])
        own, order = plain_tracker(times, bins, config)
        place = {track: n for n, track in enumerate(order)}
        last = {}
        for k, r in enumerate(at):
            got = found[packet, r[5]]
            assert (got.open_ord, got.close_ord, got.ici_ms) == (own[k], place[own[k]], times[k] - last[own[k]] if own[k] in last else None)
            last[own[k]] = times[k]


def test_mixtures():
    rng = np.random.default_rng(7)
    both = np.concatenate([20 + rng.gamma(2.0, 0.5, 400), 45 + rng.gamma(2.0, 0.5, 400)])
    values, counts = np.unique(np.round(both, 2), return_counts=True)
    assert density.fit(values, counts).k == 2
    one = density.fit(np.array([30.0, 30.1, 30.2]), np.array([5, 9, 5]), MixtureConfig(prominence=0.99))
    assert one.k == 1
    three = np.concatenate([rng.normal(m, 0.4, 300) for m in (20, 35, 50)])
    capped = density.fit(*np.unique(three, return_counts=True), MixtureConfig(max_components=2))
    assert capped.k == 2
    web = density.fit(*np.unique(three, return_counts=True), MixtureConfig(flavor="web"))
    assert web.k == 3 and np.allclose(web.means, [20, 35, 50], atol=0.2)
    assert len(web.thresholds("web")) == 2 and 20 < web.thresholds()[0] < 35


def test_uniform_values_and_errors():
    assert density.fit(np.array([40.0]), np.array([5])).peaks.tolist() == [40.0]
    with pytest.raises(ValueError):
        density.fit(np.array([40.0]), np.array([1]))
    for bad in ({"bandwidth": "best"}, {"scale": 0}, {"max_components": 0}, {"grid": 2}):
        with pytest.raises(ValueError):
            MixtureConfig(**bad)


def test_bootstrap_is_deterministic():
    v = np.array([1.0, 2.0, 5.0])
    assert validation.bootstrap_interval(v, seed=3) == validation.bootstrap_interval(v, seed=3)
    assert np.isnan(validation.bootstrap_interval(np.array([]))[0])


def test_assignment_statuses(spark):
    tracks = spark.createDataFrame([("a", 4, 10, 240, "x"), ("b", 3, 900, 1100, "x")], "track_id string, n_chirps int, start_time_ms long, end_time_ms long, passage_species string")
    calls = spark.createDataFrame([("a", t) for t in (10, 100, 220, 240)] + [("b", t) for t in (900, 1000, 1100)], "track_id string, time_ms long")
    scenarios = spark.createDataFrame([("s1", "c", 0, 250), ("s2", "c", 200, 500)], "scenario_id string, case_type string, start_ms long, end_ms long")
    found = {r.track_id: (r.scenario_id, r.assignment_status) for r in validation.assign_tracks(tracks, calls, scenarios).collect()}
    assert found == {"a": ("s1", "ambiguous_majority"), "b": ("UNASSIGNED", "unassigned_false_positive")}


def test_bootstrap_against_resampling(spark):
    """Intervals from hashed Poisson weights are those of drawing scenarios with replacement, but for chance."""
    rng = np.random.default_rng(2)
    error = rng.integers(-4, 5, 400)
    rows = spark.createDataFrame([(f"s{i}", "ab"[i % 2], i, int(e), abs(int(e)), bool(e == 0)) for i, e in enumerate(error)], "scenario_id string, case_type string, start_ms long, signed_error int, absolute_error int, exact_match boolean")
    found = {r["group"]: r for r in validation.bootstrap_table(rows).collect()}
    for group, own in (("global", error), ("a", error[::2]), ("b", error[1::2])):
        for name, values in (("bias", own), ("mae", abs(own)), ("exact", own == 0)):
            low, high = validation.bootstrap_interval(values.astype(float))
            assert abs(found[group][f"{name}_ci_low"] - low) < 0.1 * (high - low) and abs(found[group][f"{name}_ci_high"] - high) < 0.1 * (high - low)
