import random

from echoloom.operators.activity import densest_window, densest_window_bucketed


def test_densest_window_sums_each_bucket_once(spark):
    """Crowded times, ends of buckets, times below zero and null ones: the plain count of each window; no frame of rows by range."""
    rng, window = random.Random(4), 100
    rows = [("a", rng.randint(-450, 450)) for _ in range(900)] + [("b", t) for t in (-100, 0, 0, 99, 100, 100, 200)] + [("c", None)] * 2 + [("c", 7), ("d", 5), ("d", 105), ("d", 106), ("d", 206)]
    frame = spark.createDataFrame(rows, "recording_id string, time_ms long")
    expected = set()
    for name in "abcd":
        times = [t for k, t in rows if k == name]
        n, start = max((sum(u is None if t is None else u is not None and t <= u <= t + window for u in times), t is not None, -(t or 0)) for t in times)[0::2]
        expected.add((name, None, None, n) if name == "c" else (name, -start, window - start, n))
    for call in (densest_window, densest_window_bucketed):
        found = call(frame, window)
        assert {tuple(r) for r in found.collect()} == expected
        assert "RangeFrame" not in found._jdf.queryExecution().executedPlan().toString()
