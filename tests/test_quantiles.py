"""Quantiles by selection against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.operators import eda
from echoloom.operators.quantiles import quantiles

SHARES = (0.0, 0.1, 0.5, 0.95, 1.0)


def own(spark, values, bound):
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    return quantiles(rows, {str(q): (F.col("x"), q) for q in SHARES}, bound)


@pytest.mark.parametrize("case", ["doubles", "ties", "steep", "huge", "neighbours"])
def test_quantiles(spark, case):
    """A bound of eight values forces rounds; steep values crowd in one part of the interval, huge ones overflow a difference."""
    rng = np.random.default_rng(3)
    values = {
        "doubles": rng.normal(0, 5, 3001), "ties": rng.integers(-9, 30, 4000).astype(float), "steep": np.exp(rng.normal(0, 12, 2000)),
        "huge": np.concatenate([rng.normal(0, 1, 300), [-1.7e308, 1.7e308]]), "neighbours": np.nextafter(1.0, 2.0) + np.arange(40) * 2.0**-52,
    }[case]
    found = own(spark, [*values, None, float("nan"), float("inf")], 8)
    ordered = np.sort(values)
    for q in SHARES:
        at = q * (len(values) - 1)
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert found[str(q)] == pytest.approx((1 - at % 1) * low + at % 1 * high, rel=1e-12)


def test_none_and_one(spark):
    assert own(spark, [None, float("nan")], 8) == dict.fromkeys(map(str, SHARES))
    assert own(spark, [4.5], 8) == dict.fromkeys(map(str, SHARES), 4.5)


def test_figures_without_percentiles(spark):
    """Figures of a whole table keep no map of all its values in one task; an empty zone has a row of nulls."""
    rows = spark.createDataFrame([("r", t, t, g, 1, 25.0, 25.0, 25.0, 3) for t, g in ((1, None), (5, 4), (9, 4), (30, 21))], "recording_id string, time_ms long, line_no long, gap_ms long, passage_id long, fme_khz double, ft_khz double, fi_khz double, snr_db int")
    gaps, zone, none = eda.gap_stats(rows), eda.zone_summary(rows, 22, 28), eda.zone_summary(rows, 60, 70).first()
    for found in (gaps, zone, eda.sequence_sizes(rows), eda.fme_stability(rows)):
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString() and "median(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert gaps.first().median_gap == 4 and gaps.first().p95_gap == pytest.approx(19.3) and zone.first().fme_median == 25 and zone.first().median_per_sequence == 4
    assert none.n == 0 and none.fme_median is None and none.n_sequences == 0
