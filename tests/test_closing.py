import random

from echoloom.streaming.closing import PROVIDER, closed_passages


def test_passages_end_by_timers(spark, tmp_path):
    """Many recordings, a file a batch, rows out of order between batches within the delay: the passages of the whole table."""
    rng, gap, source = random.Random(8), 100, str(tmp_path / "in")
    rows = [(f"r{k}", t) for k in range(12) for t in sorted(rng.choices(range(0, 20_000), k=150))] + [("edge", 0), ("edge", 99), ("edge", 199), ("edge", 298)]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 1500))
    batches = [rows[i : i + 400] for i in range(0, len(rows), 400)] + [[("end", 90_000), (None, 5), ("r1", None)], [("end", 95_000)]]
    spark.conf.set(*PROVIDER)
    try:
        for part in batches:
            spark.createDataFrame(part, "recording_id string, time_ms long").coalesce(1).write.mode("append").parquet(source)
            stream = closed_passages(spark.readStream.schema("recording_id string, time_ms long").parquet(source), gap, "2 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            stream.option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0])
    expected = []
    for name in {r[0] for r in rows}:
        for t in sorted(t for k, t in rows if k == name):
            if expected and expected[-1][0] == name and t - expected[-1][2] < gap:
                expected[-1][2:] = [t, expected[-1][3] + 1]
            else:
                expected.append([name, t, t, 1])
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    # "end" at 95 s is still open: nothing later has come
    assert sorted(found) == sorted([*map(tuple, expected), ("end", 90_000, 90_000, 1)])
