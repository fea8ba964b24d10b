import pytest
from pyspark.sql import functions as F

from echoloom import cli, facade
from echoloom.functions import units
from echoloom.operators import clips as sim
from echoloom.operators.species import COMMON_RULES, label
from echoloom.schema import CLIP, DETECTION, TRUTH, struct
from echoloom.sinks import files
from echoloom.sources import tables
from echoloom.sources.sensor_text import parse_sensor_text, read_sensor_text

ROWS = [(1000, 97, 100, 94, 6, 25), (1080, 98, 101, 95, 6, 26), (1250, 136, 140, 132, 5, 24), (1300, 137, 141, 133, 5, 23)]


def log(rows, broken=""):
    return "\r\n".join([*files.sensor_header(len(rows)), *(" ".join(map(str, r)) for r in rows), broken, ""])


def frame(spark, rows=ROWS):
    return spark.createDataFrame([("r", n, *r) for n, r in enumerate(rows)], DETECTION)


def values(spark, column):
    return [r[0] for r in spark.range(1).select(F.explode(F.array(*column))).collect()]


def test_species_labels(spark):
    shown = values(spark, [label(F.lit(float(v))) for v in (38.7, 45, 55, 27, 20, 13, 33, 24.0, float("nan"))])
    assert shown == ["Pipistrellus kuhlii", "Pipistrellus pipistrellus", "Pipistrellus pygmaeus", "Eptesicus serotinus", "Nyctalus sp.", "Tadarida teniotis", "Indetermine", "Eptesicus serotinus", "Indetermine"]
    assert values(spark, [label(F.lit(v), COMMON_RULES, None) for v in (22.0, 33.0)]) == ["Noctule", None]


def test_units(spark):
    assert values(spark, [units.khz_to_bin(F.lit(float(v)), "simulator") for v in (0, 45, 200)]) == [0, 115, 255]
    assert values(spark, [units.duration_to_windows(F.lit(v), "simulator") for v in (0.2, 1.28, 6.4)]) == [1, 1, 5]
    assert values(spark, [units.fnv1a(F.lit("a"))]) == [3826002220]
    p = spark.range(1).select(*(units.parse_parameter(F.lit(n)).alias(f"p{i}") for i, n in enumerate(("a=5", "a=b=c", "plain")))).first()
    assert (p.p0.name, p.p0.value) == ("a", 5.0) and p.p1.name == "" and p.p2.value is None
    assert values(spark, [units.scenario_id(F.lit("dev"), F.lit("c"), F.lit(3), F.lit("k"), F.lit(1.5))]) == ["dev-c-k-1p5-0003"]
    assert values(spark, [units.padded_id("det-", F.lit(n), 6) for n in (7, 12345678)]) == ["det-000007", "det-12345678"]


def test_log_round_trip(spark, tmp_path):
    files.write_sensor_text(frame(spark), str(tmp_path / "log"))
    raw = next((tmp_path / "log").glob("part-*")).read_bytes()
    assert raw.endswith(b"1300 137 141 133 5 23\r\n") and raw.startswith(b"DETECTDATA\r\n") and raw.count(b"\n") == raw.count(b"\r\n")
    rows, meta = read_sensor_text(spark, str(tmp_path / "log"))
    assert [tuple(r)[2:] for r in rows.orderBy("line_no").collect()] == ROWS
    assert meta.first().bin_khz == 0.390625


def test_log_over_many_tasks(spark, tmp_path, monkeypatch):
    """A log of 20,000 rows is written as several ordered parts and read by many byte ranges; so is one file of it."""
    path = tmp_path / "d" / "night"
    calls = [(t * 7, 97 + t % 5, 100, 95, 6, 24) for t in range(20_000)]
    settings = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.leafNodeDefaultParallelism": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        files.write_sensor_text(frame(spark, calls).repartition(5), str(path))
        parts = sorted(path.glob("part-*"))
        whole = b"".join(p.read_bytes() for p in parts)
        assert len(parts) > 1 and whole.decode().split("\r\n") == [*files.sensor_header(20_000), *(" ".join(map(str, c)) for c in calls), ""]
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "DATA00.TXT").write_bytes(whole)
        for name, at in (("night", path), ("DATA00.TXT", tmp_path / "one")):
            rows, meta = read_sensor_text(spark, str(at))
            assert rows.select("time_ms").rdd.getNumPartitions() > 8 if name == "night" else True
            found = rows.orderBy("line_no").collect()
            assert {r.recording_id for r in found} == {name} and [r.line_no for r in found] == list(range(13, 20_013)) and [tuple(r)[2:] for r in found] == calls
            assert meta.first().bin_khz == 0.390625 and meta.count() == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_log_flavors(spark):
    text = log(ROWS, "-5 1 1 1 1 1\r\n7 8 9\r\n1.5 1 1 1 1 1")
    assert parse_sensor_text(spark, text).count() == 4
    web = [r.time_ms for r in parse_sensor_text(spark, text, "web").collect()]
    assert sorted(web) == [-5, 1250, 1300]  # it skips two lines more
    assert [r.time_ms for r in parse_sensor_text(spark, log(ROWS[::-1]), "strict").collect()] == [1000, 1080, 1250, 1300]
    assert parse_sensor_text(spark, log([])).count() == 0
    for flavor, bad in (("strict", log([])), ("web", log([])), ("strict", log(ROWS).replace("DETECTDATA", "OTHER", 1)), ("canonical", log(ROWS).replace("LENFFT", "LEN"))):
        with pytest.raises(Exception):
            parse_sensor_text(spark, bad, flavor)


def bats(spark):
    """Two bats of a regular rhythm in each of three nights of calls, and the truth about them."""
    calls = sorted((5_000 * k + 3_000 + i * step + late, fme, fme + 4, fme - 3, 6, 24 + i % 3) for k in range(3) for fme, step, late in ((97, 90, 0), (141, 90, 40)) for i in range(14))
    truth = [("dev", f"s{k}", "pair" if k else "first", 1, f"i{k}{b}", "x", 5_000 * k + 3_000, 5_000 * k + 4_800, 2, 14, 38.0, 100.0, "transit", "ici_delta_ms=5.0" if k == 2 else "") for k in range(3) for b in range(2)]
    return frame(spark, calls), spark.createDataFrame(truth, TRUTH)


def test_command_lines(spark, tmp_path, capsys):
    path, truth = str(tmp_path / "d" / "DATA"), str(tmp_path / "d" / "truth")
    rows, known = bats(spark)
    files.write_sensor_text(rows, path)
    files.write_truth_csv(known, truth)
    cli.main(["validation", "evaluate", "--input", path, "--truth", truth, "--processed-dir", str(tmp_path / "p"), "--plot-dir", str(tmp_path / "c")], spark)
    shown = capsys.readouterr().out
    assert "global" in shown and "pair" in shown and "n=    3 bias=+0.000" in shown
    cli.main(["validation", "profile", "--input", path, "--truth", truth], spark)
    assert "n_scenarios: 3" in capsys.readouterr().out
    cli.main(["individuals", path, "--tracks-csv", str(tmp_path / "t"), "--report-output", str(tmp_path / "r" / "x.txt"), "--plot-output", str(tmp_path / "f")], spark)
    assert "# Individuals counted" in (tmp_path / "r" / "x.txt").read_text() and "track-0001 passage" in next((tmp_path / "r" / "x.txt.tracks").glob("part-*")).read_text()
    head = next((tmp_path / "t").glob("part-*")).read_text().splitlines()[0]
    assert head.startswith("track_id,passage_id,packet_id")
    cli.main(["species", path, "-o", str(tmp_path / "h")], spark)
    cli.main(["zone", path, "--low-khz", "30", "--high-khz", "45"], spark)
    shown = capsys.readouterr().out
    assert "kHz a bin" in shown and "components = " in shown.replace("  ", " ").replace("  ", " ").replace("  ", " ") and "# Frequency band" in shown and "largest sequences" in shown
    assert facade.eda_feeds(facade.load(spark, path)[0])["gap_stats"].first().n_beyond > 0


def test_import_move_and_export(spark, tmp_path):
    source = tmp_path / "DATA.TXT"
    source.write_bytes(log(ROWS).encode())
    clips, rows = facade.imported_clips(spark, str(source), "store")
    assert [(r.row_start, r.row_end) for r in clips.orderBy("row_start").collect()] == [(0, 2), (2, 4)]
    store = tables.Store(spark, str(tmp_path / "stores"))
    store.add("store", rows, 0.390625)
    store.add("other", rows, 0.390625)
    assert {r.store_id: r.n_rows for r in store.list().collect()} == {"store": 4, "other": 4}
    assert [r.time_ms for r in store.get_range("store", 1, 3).collect()] == [1080, 1250]
    back = sim.sensor_rows(sim.imported_detections(clips, store.rows(), clamp=True)).orderBy("time_ms").collect()
    assert [(r.time_ms, r.pos_fme, r.snr_db) for r in back] == [(r[0], r[1], r[5]) for r in ROWS]
    moved = clips.withColumn("start_ms", F.when(F.col("row_start") == 0, F.col("start_ms") + 500).otherwise(F.col("start_ms")))
    assert sorted(r.time_ms for r in sim.imported_detections(moved, store.rows()).collect()) == [1250, 1300, 1500, 1580]
    store.remove_unused(clips)
    assert [r.store_id for r in store.list().collect()] == ["store"]
    store.clear()


CLIPS = [("c1", "sequence", 1000.0, 800.0, 100.0, 7, None), ("c2", "noise", 5000.0, 300.0, 50.0, 8, None), ("c3", "imported", 9000.0, 400.0, None, None, 120.0)]


def clip_table(spark):
    rows = [{"clip_id": c, "kind": k, "individual_id": f"{c}-i", "sequence_id": f"{c}-s", "start_ms": s, "duration_ms": d, "ici_mean_ms": i, "seed": n, "ici_median_ms": m} for c, k, s, d, i, n, m in CLIPS]
    names = [f.name for f in struct(CLIP).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CLIP)


def test_project_document(spark, tmp_path):
    clips = clip_table(spark)
    project = clips.groupBy().agg(F.collect_list(F.struct(*clips.columns)).alias("clips")).select(F.lit(1).alias("schema_version"), F.lit("p").alias("id"), "clips")
    files.write_project(project, str(tmp_path / "project"))
    back = tables.read_project(spark, str(tmp_path / "project"))
    assert tables.project_clips(back).count() == clips.count() == 3
    tables_path = str(tmp_path / "saved")
    files.save_project_table(back, tables_path)
    assert tables.load_project_table(spark, tables_path).first().id == "p"


def test_clip_edits(spark):
    clips = clip_table(spark)
    ids = spark.createDataFrame([("c1",), ("c3",)], "clip_id string")
    assert [r.clip_id for r in sim.delete_clips(clips, ids).collect()] == ["c2"]
    copies = {r.clip_id: r for r in sim.duplicates(clips, ids).collect()}
    assert copies["c1-copy"].start_ms == 2000 and copies["c1-copy"].seed == 1016 and set(copies) == {"c1-copy", "c3-copy"}
    half = {r.clip_id: r for r in sim.half_interval_copies(clips, ids).collect()}
    assert half["c1-half"].start_ms == 1050 and half["c3-half"].start_ms == 9060 and half["c1-half"].individual_id == "c1-i-half"
    noisy = {r.clip_id: r for r in sim.to_noise(clips, ids).collect()}
    assert noisy["c1-noise"].kind == "noise" and noisy["c1-noise"].duration_ms == 500 and not noisy["c1-noise"].echo_enabled and noisy["c3"].kind == "imported"
    assert [r.clip_id for r in sim.visible(clips, 4000, 8000).collect()] == ["c2"]
