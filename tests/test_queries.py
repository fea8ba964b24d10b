import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from echoloom.plans.queries import ORACLE_SQL, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda v: "null" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    found, expected = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).toPandas() is not None


def equal(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    found, expected = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert len(found) and sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", ["tracks", "tracks_unsplit", "tracks_by_species", "counting_summary", "tracks_csv", "mixture_components", "kde_sweep", "gmm_fit", "gmm_fit_web"])
def test_models_equal_sql_on_a_larger_table(spark, name):
    equal(spark, "/root/testdata/sf0.01", name)


def test_long_tracks_equal_sql(spark, tmp_path):
    """Four callers of even rhythms in one dense recording: tracks are long, meet, end and begin anew."""
    rng = random.Random(5)
    ticks = sorted((int(start + k * rhythm + rng.uniform(-9, 9)), caller) for caller, rhythm in enumerate((90, 100, 115, 130)) for start in (0, 9000) for k in range(40))
    kinds = ["click", "click", "view", "error"]
    made = [(n * 20 + 1, datetime(2024, 1, 1) + timedelta(seconds=100 + t), kinds[c], float(rng.randint(0, 40)), f'{{"k": {rng.randint(0, 20)}}}') for n, (t, c) in enumerate(ticks)]
    pd.DataFrame(made, columns=["event_id", "ts", "event_type", "value", "props"]).to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    equal(spark, str(tmp_path), "tracks_unsplit")
    assert QUERIES["tracks_unsplit"](spark, str(tmp_path)).agg({"n_chirps": "max"}).first()[0] > 20


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_bucketed_scan_deals_rows_by_bucket(spark, sf):
    """A very long recording: rows go to tasks by (recording, bucket); only the table of buckets is ordered as a whole."""
    from echoloom.operators.preprocess import sessionize

    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type as recording_id", "event_id as line_no", "unix_micros(cast(ts as timestamp)) div 1000 as time_ms")
    plan = sessionize(rows, 1000, bucket_ms=3_600_000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(recording_id" in plan
