import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from echoloom.operators import preprocess as pre
from echoloom.schema import DETECTION, PreprocessConfig

MIXED = [(930, 120, 126, 117, 4, 31), (700, 0, 0, 0, 0, 0), (700, 119, 124, 118, 4, 22), (760, 121, 127, 118, 5, 27), (700, 0, 5, 0, 0, 0)]
LINKED = [(40, 142, 149, 139, 3, 21), (48, 141, 149, 138, 3, 33), (57, 140, 147, 138, 3, 29), (400, 142, 149, 139, 3, 24)]


def frame(spark, rows, name="r"):
    return spark.createDataFrame([(name, n, *r) for n, r in enumerate(rows)], DETECTION)


def test_sorts_drops_artefacts_and_splits_passages(spark):
    done = pre.preprocess(frame(spark, MIXED), PreprocessConfig(fme_min_khz=-1.0))
    counters = done.counters.first()
    assert (counters.n_raw, counters.n_artefacts) == (5, 2)
    assert [r.time_ms for r in done.clean.orderBy("time_ms").collect()] == [700, 760, 930]
    assert [r.n_chirps for r in pre.passages(done.clean).orderBy("passage_id").collect()] == [2, 1]


@pytest.mark.parametrize("strategy,times,snr", [("drop_later", [40, 400], [21, 24]), ("best_snr", [48, 400], [33, 24])])
def test_echo_strategies(spark, strategy, times, snr):
    done = pre.preprocess(frame(spark, LINKED), PreprocessConfig(strategy=strategy))
    rows = done.clean.orderBy("time_ms").collect()
    assert [r.time_ms for r in rows] == times and [r.snr_db for r in rows] == snr
    assert done.counters.first().n_echoes == 2


def test_unknown_strategy():
    with pytest.raises(ValueError):
        PreprocessConfig(strategy="loudest")


def test_empty_table(spark):
    done = pre.preprocess(frame(spark, []))
    assert done.clean.count() == 0 and done.counters.count() == 0


def test_min_passage_chirps_keeps_numbers(spark):
    done = pre.preprocess(frame(spark, [(0, 97, 100, 94, 6, 20), (500, 97, 100, 94, 6, 20), (580, 98, 100, 94, 6, 20)]), PreprocessConfig(min_passage_chirps=2))
    assert [r.passage_id for r in pre.passages(done.clean).collect()] == [2]
    assert done.counters.first().n_passages_detected == 1


@pytest.mark.parametrize("bucket", [None, 70, 3_600_000])
def test_segments(spark, bucket):
    rows = frame(spark, [(t, 90, 93, 88, 4, 20) for t in (10, 65, 70, 300, 390, 490, 495)])
    assert [(r.row_start, r.row_end) for r in pre.segments(rows, 100, bucket).orderBy("segment").collect()] == [(0, 3), (3, 5), (5, 7)]


detection = st.tuples(st.integers(0, 400), st.integers(44, 50), st.just(60), st.just(40), st.integers(0, 6), st.integers(0, 30))


def oracle(rows, strategy):
    """Plain re-statement for one recording: (passage of every clean row, lines that are no echoes)."""
    kept = sorted((r[0], n, r) for n, r in enumerate(rows) if not (r[1] == 0 and r[5] == 0 and r[4] == 0))
    passage, number, chain, chains = {}, 0, None, []
    for k, (t, n, r) in enumerate(kept):
        gap = None if k == 0 else t - kept[k - 1][0]
        number += gap is None or gap >= 100
        passage[n] = number
        linked = gap is not None and gap <= 10 and abs(r[1] - kept[k - 1][2][1]) <= 1
        if not linked:
            chain = []
            chains.append(chain)
        chain.append((r[5], n))
    if strategy == "drop_later":
        return passage, {c[0][1] for c in chains}
    return passage, {max(c, key=lambda x: x[0])[1] for c in chains}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(detection, min_size=1, max_size=40), strategy=st.sampled_from(["drop_later", "best_snr"]), bucket=st.sampled_from([None, 37]))
def test_against_a_plain_version(spark, rows, strategy, bucket):
    passage, left = oracle(rows, strategy)
    found = pre.preprocess(frame(spark, rows), PreprocessConfig(strategy=strategy, bucket_ms=bucket)).flagged.collect()
    assert {r.line_no: r.passage_id for r in found} == passage
    assert {r.line_no for r in found if not r.is_echo} == left


def test_counters_add_up(spark, sf):
    from echoloom.plans.events_view import detections

    c = pre.preprocess(detections(spark, sf)).counters.first()
    assert c.n_raw == c.n_artefacts + c.n_clean and c.n_clean == c.n_echoes + c.n_no_echo and c.n_no_echo == c.n_social + c.n_filtered


def test_lines_of_a_passage_are_joined_by_buckets(spark):
    """A passage over many buckets, ties and times below zero: its lines in order, and no task that gathers a passage's rows."""
    from echoloom.operators.preprocess import passage_lines

    rng = random.Random(6)
    rows = [("r", 1 + (t > 200), t, n) for n, t in enumerate(rng.choices(range(-300, 900), k=2000))] + [("s", 1, 5, 7)]
    frame = spark.createDataFrame(rows, "recording_id string, passage_id2 long, time_ms long, line_no long")
    found = passage_lines(frame, 50)
    got = {(r.recording_id, r.passage_id): (r.n_chirps, r.lines) for r in found.collect()}
    for key in {r[:2] for r in rows}:
        own = sorted(r[2:] for r in rows if r[:2] == key)
        assert got.pop(key) == (len(own), ",".join(str(n) for _, n in own))
    assert not got
    assert "hashpartitioning(recording_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "_bucket" in plan


def test_nested_passages_hold_whole_chirps(spark, sf):
    """Chirps with all their fields, in order, in parts by bucket as in one row; the query's lines are read from them."""
    from echoloom.plans.events_view import detections
    from echoloom.plans.queries import QUERIES

    clean = pre.preprocess(detections(spark, sf), PreprocessConfig(passage_gap_ms=9000, echo_gap_ms=60)).clean
    whole = {r.passage_id: r for r in pre.nested_passages(clean).collect()}
    parts = pre.nested_passages(clean, 7200).orderBy("passage_id", "part").collect()
    joined = {}
    for r in parts:
        joined.setdefault(r.passage_id, []).append(r)
    assert len(parts) > len(whole) > 1 and joined.keys() == whole.keys()
    fields = ["time_ms", "line_no", *pre.CHIRP.values()]
    rows = {r.line_no: r for r in clean.withColumn("gap_ms", clean.gap_ms2).select("passage_id2", *fields).collect()}
    for passage, r in whole.items():
        own = joined[passage]
        assert [c for p in own for c in p.chirps] == r.chirps and len(r.chirps) == r.n_chirps == sum(p.n_chirps for p in own)
        assert (r.start_ms, r.end_ms) == (own[0].start_ms, own[-1].end_ms) == (r.chirps[0].time_ms, r.chirps[-1].time_ms)
        assert all(c.asDict() == {f: rows[c.line_no][f] for f in fields} and rows[c.line_no].passage_id2 == passage for c in r.chirps)
    lines = {r.passage_id: (r.start_ms, r.end_ms, r.lines) for r in pre.passage_lines(clean, 7200).collect()}
    assert lines == {k: (r.start_ms, r.end_ms, ",".join(str(c.line_no) for c in r.chirps)) for k, r in whole.items()}
    plan = QUERIES["nested_passages"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert any("collect_list(struct(time_ms" in line and all(name in line for name in pre.CHIRP.values()) for line in plan.splitlines())
