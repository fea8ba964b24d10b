import numpy as np
from pyspark.sql import functions as F

from echoloom.operators.numbering import number_rows
from echoloom.operators.ranges import points_in_intervals
from echoloom.schema import DETECTION
from echoloom.streaming.passages import passage_writer, read_passages, stream_passages


def test_passages_go_on_across_batches(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame([("r", n, t, 97, 100, 94, 6, 25) for n, t in rows], DETECTION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_passages(spark.readStream.schema(DETECTION).parquet(str(tmp_path / "in")), 100).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        stream.option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run([(0, 0), (1, 80), (2, 180), (3, 279)], "a")
    run([(4, 300), (5, 250), (6, 500)], "b")
    found = {r.line_no: (r.gap_ms, r.passage_id, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # a gap of exactly the limit ends a passage; the call from before the last one seen is late
    assert found == {0: (None, 1, False), 1: (80, 1, False), 2: (100, 2, False), 3: (99, 2, False), 4: (21, 2, False), 5: (None, None, True), 6: (200, 3, False)}


def test_numbers_follow_the_order_over_tasks(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("t"), "id")
    found = number_rows(rows, ["t", "id"], parts=7).orderBy("t").collect()
    assert [r.number for r in found] == list(range(1, 1001))
    assert number_rows(rows.limit(0), ["t", "id"]).count() == 0


def test_interval_join_against_all_pairs(spark):
    points = spark.range(300).select((F.col("id") * 37 % 1000).alias("t"), F.col("id").alias("p"))
    spans = spark.range(40).select(F.col("id").alias("s"), (F.col("id") * 53 % 900).alias("a"), (F.col("id") * 53 % 900 + F.col("id") * 11 % 170).alias("b"))
    found = {(r.p, r.s) for r in points_in_intervals(points, "t", spans, "a", "b", 50).collect()}
    assert found == {(p.p, s.s) for p in points.collect() for s in spans.collect() if s.a <= p.t <= s.b}


def test_points_in_intervals_of_any_length(spark):
    """Lengths from 0 to ten million: the plain join's pairs, and rows listed by the logarithm of the length."""
    from echoloom.operators.ranges import _nodes

    rng = np.random.default_rng(11)
    lengths = np.concatenate([rng.integers(0, 10, 40), (10 ** rng.uniform(0, 7, 60)).astype(int)])
    starts = rng.integers(-5_000_000, 5_000_000, 100)
    spans = [(i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(starts, lengths))] + [(100, 9, 3)]
    points = [int(t) for t in rng.integers(-5_000_000, 9_000_000, 400)] + [s for _, s, _ in spans] + [e for _, _, e in spans]
    frame = spark.createDataFrame(spans, "s int, a long, b long")
    found = points_in_intervals(spark.createDataFrame([(n, t) for n, t in enumerate(points)], "p int, t long"), "t", frame, "a", "b", 50).select("p", "s").collect()
    assert sorted(map(tuple, found)) == sorted((n, i) for n, t in enumerate(points) for i, a, b in spans if a <= t <= b)
    listed = frame.select(F.size(_nodes(F.floor(F.col("a") / 50), F.floor(F.col("b") / 50) + 1)).alias("n"), "a", "b").filter("a <= b").collect()
    assert all(r.n <= 2 * np.log2((r.b - r.a) / 50 + 2) + 2 for r in listed)


def test_activity_of_long_tracks(spark):
    """A track of a million bins costs two rows; counts equal those by bin."""
    from echoloom.operators.activity import activity_bins

    tracks = [("a", 0, 5_000_000_000), ("a", 12_000, 12_000), ("b", 4_999, 20_001), ("b", 10_000, 14_999), ("a", 4_999_990_000, 5_000_000_000)]
    bins = activity_bins(spark.createDataFrame(tracks, "species string, start_time_ms long, end_time_ms long"), 5_000)
    for species, place in (("a", 2), ("a", 3), ("a", 999_999), ("b", 0), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("b", 5), ("a", 1_000_000)):
        want = sum(k == species and s <= (place + 1) * 5_000 and e >= place * 5_000 for k, s, e in tracks)
        assert bins.filter((F.col("species") == species) & (F.col("bin") == place)).first()["n_tracks"] == want
    assert bins.count() == 2 * 1_000_001


def test_passages_of_large_batches(spark, tmp_path):
    """As above, by buckets of time in Spark: no Python worker holds a batch, a recording stays away for a batch."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame([(k, n, t, 97, 100, 94, 6, 25) for k, n, t in rows], DETECTION).write.mode("append").parquet(source)
        writer = passage_writer(spark.readStream.schema(DETECTION).parquet(source), 100, out, 150).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()

    run([("r", 0, 0), ("r", 1, 80), ("r", 2, 180), ("r", 3, 279), ("s", 10, -500)])
    run([("r", 4, 300), ("r", 5, 250), ("r", 6, 500), ("new", 20, 5)])
    run([("r", 7, 500), ("s", 11, -401), ("s", 12, -400), ("s", 13, -300), ("s", 14, -600)])
    found = {r.line_no: (r.gap_ms, r.passage_id, r.late) for r in read_passages(spark, out).collect()}
    assert found == {
        0: (None, 1, False), 1: (80, 1, False), 2: (100, 2, False), 3: (99, 2, False), 4: (21, 2, False), 5: (None, None, True), 6: (200, 3, False), 7: (0, 3, False),
        10: (None, 1, False), 11: (99, 1, False), 12: (1, 1, False), 13: (100, 2, False), 14: (None, None, True), 20: (None, 1, False),
    }
