"""Whitening against a plain version in exact integers and double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import registry, whitening


def plain(vectors):
    """{vec_id index: deviation}, n, eigenvalues, eigenvectors, shares of plain lists."""
    width = max(map(len, vectors))
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] + [100000] * (width - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    steps = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array([[s / n for s in row] for row in steps])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return n, [sum(s * s for s in row) for row in steps], centred, values[::-1], axes[:, ::-1], np.trace(cov)


def agree(got, ids, vectors):
    n, deviations, centred, values, axes, trace = plain(vectors)
    count = min(8, int((values > 1e-14 * trace).sum()))
    assert len(got) == len(ids) * count and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = centred @ axes[:, :count] / np.sqrt(values[:count])
    signs = np.sign((wide * want).sum(0))
    np.testing.assert_allclose(wide, want * signs, atol=1e-6)
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip(ids, deviations))
    shares = got.groupby("component").explained.agg(["min", "max"])
    np.testing.assert_allclose(shares["min"], values[:count] / trace, rtol=1e-9)
    assert (shares["min"] == shares["max"]).all() and list(shares.index) == list(range(1, count + 1))


def test_op12_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = registry.QUERIES["op12_whitening"](spark, sf).toPandas()
    agree(got, list(rows.vec_id), list(rows.embedding))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "n", "component", "deviation", "white", "place", "v")})


def test_op12_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)] + [(40, [0.25, 0.5]), (41, [1e3, -1e3, 3.0, 0.0, 1.0])]
    bad = [(50, None), (51, [1.0, None]), (52, [float("nan")]), (53, [float("inf"), 1.0])]
    got = whitening.whiten(whitening.whole_numbers(frame(spark, rows + bad).repartition(3))).toPandas()
    n, deviations, centred, values, axes, trace = plain([v for _, v in rows])
    assert set(got.vec_id) == set(range(42)) and dict(zip(got.vec_id, got.deviation)) == dict(zip(range(42), deviations)) and set(got.n) == {42}
    repeats = whitening.whiten(whitening.whole_numbers(frame(spark, rows[:10] * 3 + [(None, rows[3][1])]))).toPandas()
    assert set(repeats.n) == {31} and (repeats.groupby(repeats.vec_id.fillna(-1)).size() == [5] + [15] * 10).all()
    for few in ([], bad, rows[:1], [rows[0]] * 4, [(1, [])]):
        assert whitening.whiten(whitening.whole_numbers(frame(spark, few))).count() == 0


def test_op12_large_entries(spark):
    """Sums and deviations beyond 64 bits: exact sums, deviations held at the largest long."""
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])]
    whole = whitening.whole_numbers(frame(spark, rows))
    assert [r["x"][0] for r in whole.orderBy("vec_id").collect()] == [2**52 + 100000, -(2**52) + 100000, 100000]
    n, sums, _ = whitening.moments(whole)
    assert (n, sums) == (3, [300000, 1024 * 6 + 300000])
    got = whitening.whiten(whole).toPandas()
    assert dict(zip(got.vec_id, got.deviation)) == {1: 2**63 - 1, 2: 2**63 - 1, 3: (3 * 3072 - 6144) ** 2}


def test_op12_components_fall(spark):
    values, axes = whitening.components(np.diag([1.0, 4.0, 0.0, 9.0]))
    assert values == pytest.approx([9, 4, 1]) and np.allclose(np.abs(axes).argmax(0), [3, 1, 0])
