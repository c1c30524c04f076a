"""Ranks, exact quantiles and rank statistics of whole columns, with no task that holds them.

Equal values are one row with a count. These rows are dealt by ranges of the value; each range adds up its own counts, and what stands before a
range is the sum of the ranges below it, of which there are as many as there are shuffle partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def value_ranks(scratch: Scratch, df: DataFrame, column: str, **sums: Column) -> DataFrame:
    """``value``, and for each of ``sums`` (by default ``n``, the rows) its total at the value and, as ``<name>_upto``, up to and with it. Null values are left out."""
    sums = sums or {"n": F.count("*")}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(*(x.alias(c) for c, x in sums.items()))
    values = scratch.cut(values.repartitionByRange(tasks, "value").withColumn("_part", F.spark_partition_id()))
    below = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = values.groupBy("_part").agg(*(F.sum(c).alias(c) for c in sums)).select("_part", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"_{c}") for c in sums))
    own = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return values.join(F.broadcast(before), "_part").select("value", *sums, *((F.col(f"_{c}") + F.sum(c).over(own)).alias(f"{c}_upto") for c in sums))


def quantiles(scratch: Scratch, df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """The exact quantiles (between two values by the share of the way) of a column's values that are not null; none, if there are none."""
    ranks = scratch.cut(value_ranks(scratch, df, column))
    n = ranks.agg(F.max("n_upto")).first()[0]
    if not n:
        return None
    at = [share * (n - 1) for share in shares]
    wanted = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
    fits = lambda k: (F.col("n_upto") - F.col("n") <= k) & (F.col("n_upto") > k)
    found = ranks.select("value", F.explode(F.filter(F.lit(wanted), fits)).alias("k")).collect()  # two rows for a share at most
    value = {r["k"]: r["value"] for r in found}
    return [value[int(x)] if x == int(x) else (math.ceil(x) - x) * value[math.floor(x)] + (x - math.floor(x)) * value[math.ceil(x)] for x in at]


def spearman(scratch: Scratch, df: DataFrame, x: str, y: str) -> float | None:
    """The rank correlation of two columns over the rows that have both; ties have their mean rank. None if a column doesn't vary."""
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    for c in "xy":
        ranks = value_ranks(scratch, both, c).select(F.col("value").alias(c), (F.col("n_upto") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))
        both = both.join(ranks, c)
    r = both.agg(F.corr("rank_x", "rank_y"), F.countDistinct("rank_x"), F.countDistinct("rank_y")).first()
    return r[0] if min(r[1], r[2]) > 1 else None


def kolmogorov_smirnov(scratch: Scratch, df: DataFrame, x: str, y: str) -> tuple[float | None, float | None]:
    """The largest distance of the distribution functions of two columns, and its asymptotic chance; each column by its own values that are not null."""
    pairs = F.explode(F.array(*(F.struct(F.col(c).alias("value"), F.lit(k).alias("of")) for k, c in enumerate((x, y)))))
    ranks = scratch.cut(value_ranks(scratch, df.select(pairs.alias("e")).select("e.*"), "value", a=F.count_if(F.col("of") == 0), b=F.count_if(F.col("of") == 1)))
    totals = ranks.agg(F.max("a_upto").alias("a"), F.max("b_upto").alias("b")).first()
    if not totals["a"] or not totals["b"]:
        return None, None
    d = ranks.agg(F.max(F.abs(F.col("a_upto") / totals["a"] - F.col("b_upto") / totals["b"]))).first()[0]
    z = d * math.sqrt(totals["a"] * totals["b"] / (totals["a"] + totals["b"]))
    chance = 1.0 if z < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    return d, min(1.0, max(0.0, chance))
