"""Diversity of samples from their count spectra: how many clonotypes have each count.

The spectrum is one small aggregation over the cohort, whatever the number of clonotypes; every estimator is an
aggregate of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clonotype import SAMPLE


def spectrum(df: DataFrame, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """``count`` and ``clones`` having it, for positive counts."""
    return df.where("duplicate_count > 0").groupBy(*by, F.col("duplicate_count").alias("count")).agg(F.count("*").alias("clones"))


def _only(k: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("count") == k, F.col("clones"))), F.lit(0))


def thisted_coefficients(depth: int) -> list[float]:
    """Of the alternating binomial sum at one depth: ``h(x) = (-1)^(x+1) P(Bin(depth, 1/2) >= x)``."""
    tail = lambda x: sum(math.comb(depth, y) for y in range(x, depth + 1)) / 2**depth
    return [(-1) ** (x + 1) * tail(x) for x in range(1, depth + 1)]


def efron_thisted(first: Column, observed: Column, max_depth: int = 20, cv: float = 0.05) -> Column:
    """Extrapolated richness: the first depth whose standard deviation is at least ``cv`` of it, else the deepest.

    ``first``: how many clonotypes have the counts 1 to ``max_depth``.
    """
    steps = []
    for depth in range(1, max_depth + 1):
        h = thisted_coefficients(depth)
        pick = F.slice(first, 1, depth)
        s = observed + F.aggregate(F.zip_with(pick, F.array(*map(F.lit, h)), lambda f, w: f * w), F.lit(0.0), lambda a, x: a + x)
        d = F.sqrt(F.aggregate(F.zip_with(pick, F.array(*map(F.lit, h)), lambda f, w: f * w * w), F.lit(0.0), lambda a, x: a + x))
        steps.append(F.struct(s.alias("s"), d.alias("d")))
    all_ = F.array(*steps)
    return F.coalesce(F.get(F.filter(all_, lambda x: x["d"] / x["s"] >= cv), F.lit(0))["s"], F.element_at(all_, max_depth)["s"])


def diversity_stats(df: DataFrame, *, by: tuple[str, ...] = (SAMPLE,), extrapolate_to: float | None = None) -> DataFrame:
    """All estimators, one row for each sample."""
    sp = spectrum(df, by)
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc("count"))
    sp = sp.withColumn("n", F.sum(F.col("count") * F.col("clones")).over(w)).withColumn("p", F.col("count") / F.col("n"))
    # d50: of the classes in falling order, how many clonotypes bring the running share to one half.
    before = F.coalesce(F.sum(F.col("count") * F.col("clones")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = F.ceil((0.5 * F.col("n") - before) / F.col("count"))
    sp = sp.withColumn("half", F.least(F.greatest(need, F.lit(0)), F.col("clones")))
    first = F.array(*(_only(k).cast("double") for k in range(1, 21)))
    out = sp.groupBy(*by).agg(
        F.max("n").alias("reads"), F.sum("clones").alias("observed"), _only(1).alias("f1"), _only(2).alias("f2"), first.alias("first"),
        F.sum(-F.col("clones") * F.col("p") * F.log("p")).alias("h"), F.sum(F.col("clones") * F.col("p") * F.col("p")).alias("d"), F.sum("half").alias("half"),
    )
    s, f1, f2, n = (F.col(c).cast("double") for c in ("observed", "f1", "f2", "reads"))
    f0 = f1 * (f1 - 1) / (2 * (f2 + 1))
    beyond = (F.lit(float(extrapolate_to)) if extrapolate_to else 2 * n) - n
    chao_e = F.when(f0 > 0, s + f0 * (1 - F.pow(1 - f1 / (n * f0), beyond))).otherwise(s)
    return out.select(
        *by, "reads", "observed", (s + f0).alias("chao1"), chao_e.alias("chao_e"), efron_thisted(F.col("first"), s).alias("efron_thisted"), F.exp("h").alias("shannon_wiener"),
        F.when(s > 1, F.col("h") / F.log(s)).otherwise(0.0).alias("normalized_shannon_wiener"), (1 / F.col("d")).alias("inverse_simpson"), (1 - F.col("half") / s).alias("d50"),
    )


def hill(df: DataFrame, orders: tuple[float, ...] = (0, 1, 2), *, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Empirical Hill numbers."""
    sp = spectrum(df, by).withColumn("p", F.col("count") / F.sum(F.col("count") * F.col("clones")).over(Window.partitionBy(*by)))
    aggs = [(F.exp(F.sum(-F.col("clones") * F.col("p") * F.log("p"))) if q == 1 else F.pow(F.sum(F.col("clones") * F.pow("p", F.lit(float(q)))), 1 / (1 - q))).alias(f"hill_{q}") for q in orders]
    return sp.groupBy(*by).agg(*aggs)
