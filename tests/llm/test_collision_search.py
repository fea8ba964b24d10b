"""Collision-counting search: recall and exact scores against all products, ties, repeats, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import collision_search as search
from echoloom.llm import registry


def checked(got, ids, vectors, k=20):
    """Recall of rows (query_id, rank, vec_id, score) of distinct ids; ranks, order and scores must hold exactly."""
    place = {i: n for n, i in enumerate(ids)}
    hits = wanted = 0
    for query, rows in got.sort_values("rank").groupby("query_id"):
        products = vectors @ vectors[place[query]]
        products[place[query]] = -np.inf
        want = min(k, len(ids) - 1)
        assert list(rows["rank"]) == list(range(1, want + 1)) and rows.vec_id.is_unique and query not in set(rows.vec_id)
        found = [place[i] for i in rows.vec_id]
        np.testing.assert_allclose(rows.score, products[found], rtol=1e-12, atol=1e-13)
        assert sorted(zip(-rows.score, rows.vec_id)) == list(zip(-rows.score, rows.vec_id))
        best = np.sort(products)[-want]
        hits += int((products[found] >= best - 1e-12).sum())
        wanted += want
    return hits / wanted


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_op11_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    got = registry.QUERIES["op11_collision_search"](spark, folder).toPandas()
    assert set(got.query_id) == {i for i in rows.vec_id if i % 20 == 0}
    assert checked(got, list(rows.vec_id), np.array(list(rows.embedding), float)) >= 0.95


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "cell", "asks", "place", "score", "rank")})


def test_op11_clustered_and_long_vectors(spark):
    """Tight clusters end early; lengths that differ by a thousand make the largest product another thing than the nearest."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    tight = centres[rng.integers(0, 60, 3000)] + 0.02 * rng.normal(size=(3000, 16))
    for vectors in (tight, rng.normal(size=(1500, 16)) * 10 ** rng.uniform(0, 3, (1500, 1))):
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
        got = search.nearest(search.usable(frame(spark, rows)), "vec_id % 20 = 0").toPandas()
        assert checked(got, list(range(len(rows))), vectors) >= 0.9


def test_op11_early_end():
    """A query with near neighbours opens narrow windows: it verifies few of the rows."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(20_000, 32))
    vectors[:40] = vectors[0] + 0.05 * rng.normal(size=(40, 32))
    ids = np.arange(20_000)
    shard = search.Shard(ids, ids, vectors, float(search.norms(vectors).max()))
    counted = []
    verify = shard._verified
    shard._verified = lambda q, p, ln, found, *rest: (counted.append(len(found)), verify(q, p, ln, found, *rest))[1]
    length = search.norms(vectors[:1])
    begin, end = shard.windows(vectors[:1] * 1.0, length)
    rows, _ = shard.search(vectors[0], 0, float(length[0]), begin[0], end[0], 20)
    exact = set(np.argsort(-(vectors @ vectors[0]))[:40])
    assert set(rows) <= exact and sum(counted) < 20_000


def test_op11_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (3, [2.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf")]), (None, [1.0, 1.0]), (9, []), (60, [1e-200, 0.0])]
    got = search.nearest(search.usable(frame(spark, rows)), "vec_id % 20 = 0").toPandas()
    rows_of = lambda q: sorted((r.rank, r.vec_id, r.score) for r in got[got.query_id == q].itertuples())
    assert rows_of(0) == [(1, 3, 2.0), (2, 20, 0.5), (3, 20, 0.5), (4, 60, 1e-200)]
    assert rows_of(20) == sorted([(1, 3, 1.0), (2, 0, 0.5), (3, 20, 0.5), (4, 60, 5e-201)] * 2)  # each of two rows asks and finds the other
    assert set(got.query_id) == {0, 20, 60}
    for few in ([], rows[3:4], rows[4:10]):
        assert search.nearest(search.usable(frame(spark, few)), "vec_id % 20 = 0").count() == 0
    assert search.nearest(search.usable(frame(spark, rows[:1])), "vec_id % 20 = 0").count() == 0


def test_op11_copies_tie_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    one = [float(c) for c in rng.normal(size=24)]
    rows = [(i, one if i % 3 else [float(c) for c in 0.3 * rng.normal(size=24)]) for i in range(4000)]
    got = search.nearest(search.usable(frame(spark, rows).repartition(5)), "vec_id % 20 = 0").toPandas()
    copies = [i for i in range(4000) if i % 3]
    for query, found in got.sort_values("rank").groupby("query_id"):
        if query % 3:
            assert list(found.vec_id) == [i for i in copies if i != query][:20] and found.score.nunique() == 1
