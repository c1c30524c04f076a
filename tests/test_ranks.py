"""Ranks and quantiles of whole columns against plain versions."""

import math
import random

import numpy as np
import pytest

from immunoframe.operators.dynamics import tmm_factor
from immunoframe.operators.ranks import kolmogorov_smirnov, quantiles, spearman, value_ranks
from immunoframe.sources.scratch import Scratch


@pytest.fixture
def scratch(spark):
    held = Scratch(spark, "ranks")
    yield held
    held.close()


def mean_ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def test_ranks_and_quantiles(spark, scratch):
    """A third of the rows have one value; nulls are left out."""
    rng = random.Random(3)
    xs = [7.5 if rng.random() < 0.33 else round(rng.gauss(0, 5), 1) for _ in range(700)]
    ys = [x + rng.choice([0, 1, -3]) for x in xs]
    df = spark.createDataFrame([*zip(xs, ys, strict=True), (None, 1.0), (2.0, None), (None, None)], "x double, y double")
    got = {r.value: (r.n, r.n_upto) for r in value_ranks(scratch, df, "x").collect()}
    assert got == {v: ([*xs, 2.0].count(v), sum(x <= v for x in [*xs, 2.0])) for v in {*xs, 2.0}}
    shares = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    assert quantiles(scratch, df, "x", shares) == pytest.approx(list(np.quantile([*xs, 2.0], shares)))
    assert spearman(scratch, df, "x", "y") == pytest.approx(np.corrcoef(mean_ranks(xs), mean_ranks(ys))[0, 1])
    a, b = [*xs, 2.0], [*ys, 1.0]
    d = max(abs(sum(x <= v for x in a) / len(a) - sum(y <= v for y in b) / len(b)) for v in a + b)
    z = d * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    assert kolmogorov_smirnov(scratch, df, "x", "y") == pytest.approx((d, min(1, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))))


def test_ranks_of_odd_tables(spark, scratch):
    none = spark.createDataFrame([(None, None)], "x double, y double")
    assert quantiles(scratch, none, "x", [0.5]) is None and spearman(scratch, none, "x", "y") is None and kolmogorov_smirnov(scratch, none, "x", "y") == (None, None)
    one = spark.createDataFrame([(4.0, 1.0)], "x double, y double")
    assert quantiles(scratch, one, "x", [0.0, 0.5, 1.0]) == [4.0] * 3 and spearman(scratch, one, "x", "y") is None
    assert tmm_factor(spark.createDataFrame([(3, 4)], "count_a long, count_b long")) == 1.0
