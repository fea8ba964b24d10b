"""Models of recordings by Spark rounds against the plain fit of one list of values."""

import numpy as np
import pytest

from echoloom.operators import density, mixtures
from echoloom.schema import MixtureConfig

BIN = 0.390625
CONFIGS = [MixtureConfig(), MixtureConfig(flavor="web"), MixtureConfig(bandwidth="silverman", scale=0.5, max_components=3), MixtureConfig(flavor="web", bandwidth="silverman", max_components=2), MixtureConfig(bandwidth=0.3, prominence=0.99, min_distance_khz=5.0)]
PARTS = {"three": [(20, 1, 300), (38, 1.5, 500), (47, 2, 400)], "wide": [(30, 3, 50)], None: [(40, 0, 9)], "close": [(25, 1, 200), (27, 1, 200), (55, 2, 30)], "single": [(33, 0, 1)], "pair": [(20, 0, 1), (60, 0, 2)]}


def frame(spark, values):
    return spark.createDataFrame([(name, float(v)) for name, own in values.items() for v in own], "recording_id string, fme_khz double")


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    return {name: np.concatenate([np.round(rng.normal(m, s, n) / BIN) * BIN for m, s, n in parts]) for name, parts in PARTS.items()}


@pytest.fixture(scope="module")
def models(spark, values):
    rows = frame(spark, values | {"three": np.append(values["three"], [np.nan, np.inf, -np.inf])}).unionByName(spark.createDataFrame([("wide", None), ("nothing", None)], "recording_id string, fme_khz double"))
    return mixtures.fit_models(rows, CONFIGS)


def test_models_equal_the_plain_fit(models, values):
    """Both flavors, a null key, equal values, values that aren't finite; recordings of fewer than two have no model."""
    found = {(r.recording_id, r.config): r for r in models.collect()}
    assert found.keys() == {(name, c) for name in PARTS if name != "single" for c in range(len(CONFIGS))}
    for (name, number), r in found.items():
        plain = density.fit(*np.unique(values[name], return_counts=True), CONFIGS[number])
        assert r.k == plain.k and r.start == 0
        for a, b in ((r.means, plain.means), (r.sigmas, plain.sigmas), (r.weights, plain.weights), (r.peaks, plain.peaks), (r.grid, plain.grid), (r.density, plain.density)):
            assert len(a) == len(b) and np.allclose(a, b, atol=1e-6)
        assert np.allclose(r.thresholds, plain.thresholds(CONFIGS[number].flavor), atol=1e-5)


def test_no_python_worker_and_no_list_of_counts(models):
    plan = models._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_later_start_may_be_likelier(spark):
    """Three groups, two components: the two highest peaks are neighbours, the better model joins them."""
    rng = np.random.default_rng(4)
    v = np.round(np.concatenate([rng.normal(20, 0.8, 500), rng.normal(25, 0.8, 500), rng.normal(58, 0.8, 300)]), 1)
    one, many = (mixtures.fit_models(frame(spark, {"a": v}), [MixtureConfig(max_components=2, scale=0.3, n_init=n, seed=7)]).first() for n in (1, 8))
    assert one.start == 0 and many.start > 0 and many.log_likelihood > one.log_likelihood + 50
    assert np.allclose(many.means, [22.5, 58], atol=0.3)
    again = mixtures.fit_models(frame(spark, {"a": v}), [MixtureConfig(max_components=2, scale=0.3, n_init=8, seed=7)]).first()
    assert again.start == many.start and np.allclose(again.means, many.means, atol=1e-9)


def test_empty_table(spark):
    none = frame(spark, {})
    assert mixtures.fit_models(none).count() == 0 and mixtures.densities(none).count() == 0
