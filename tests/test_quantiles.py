"""Exact quantiles against sorted values, whatever the interval that is fetched."""

import numpy as np
import pytest

from wavecrest.operators.quantiles import exact_quantiles, values_at


@pytest.mark.parametrize("few", [0, 1, 7, 10_000])
def test_ranks(spark, few):
    rng = np.random.default_rng(few)
    x = np.concatenate([rng.standard_normal(700), np.full(400, 0.25), rng.integers(-3, 3, 300), [1e300, -1e300, np.inf, -np.inf, 5e-324, 0.0]])
    rows = spark.createDataFrame([(float(v),) for v in rng.permutation(x)] + [(None,), (float("nan"),)], "v double").repartition(5)
    order = np.sort(x)
    ranks = [0, 1, 350, 700, 900, 1200, len(x) - 2, len(x) - 1]
    assert values_at(rows, "v", ranks, few) == [order[r] for r in ranks]
    with pytest.raises(ValueError):
        values_at(rows, "v", [len(x)])


def test_fractions(spark):
    x = np.random.default_rng(2).standard_normal(501)
    rows = spark.createDataFrame([(float(v),) for v in x], "v double")
    at = [0.0, 0.1, 0.333, 0.5, 0.999, 1.0]
    assert np.allclose(exact_quantiles(rows, "v", at, few=5), np.quantile(x, at), rtol=0, atol=1e-15)
    assert exact_quantiles(rows.limit(0), "v", [0.5, 0.9]) == [None, None]
    assert exact_quantiles(rows.limit(1), "v", [0.0, 1.0], few=0) == [rows.first().v] * 2
    with pytest.raises(ValueError):
        exact_quantiles(rows, "v", [1.1])
