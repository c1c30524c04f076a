"""Pairs of rows that share a key, where a key may be shared by very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About how many rows of a key stand in one block.
TILE = 1000


def pairs_within(rows: DataFrame, key: list[str], who: str, kept: list[str], tile: int = TILE) -> DataFrame:
    """``<who>_a < <who>_b`` of rows that agree in ``key``, with ``<column>_a`` and ``<column>_b`` for each of ``kept``; ``who`` is unique in a key.

    A key of n rows is joined as n / tile blocks, each block with each: no task gets more than two blocks of a key, and a
    row is copied once for each block, so what is shuffled stays a share of 1 / tile of the pairs that come out.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("_rows")).where("_rows > 1")
    rows = rows.join(counts, key).withColumn("_blocks", F.ceil(F.col("_rows") / tile).cast("int"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(who), F.col("_blocks")).cast("int"))
    side = lambda s, lo, hi: rows.select(*key, F.struct(who, *kept).alias(s), lo.alias("_lo"), hi.alias("_hi"))
    x = side("x", F.col("_block"), F.explode(F.sequence("_block", F.col("_blocks") - 1)))
    y = side("y", F.explode(F.sequence(F.lit(0), "_block")), F.col("_block"))
    ordered = F.col(f"x.{who}") < F.col(f"y.{who}")
    met = x.join(y, [*key, "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | ordered)
    pick = lambda c, first, then: F.when(ordered, F.col(f"{first}.{c}")).otherwise(F.col(f"{then}.{c}"))
    return met.select(*key, *(pick(c, *of).alias(f"{c}_{s}") for c in (who, *kept) for s, of in (("a", "xy"), ("b", "yx"))))


def pairs_between(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """The join of two tables by ``key``, block by block; ``a`` and ``b`` deal the rows to blocks.

    Both tables say in ``_blocks``, the same for all rows of a key, into how many blocks its rows of each side are to go.
    """
    side = lambda rows, who, lo, hi: rows.withColumns({lo: F.pmod(F.xxhash64(who), F.col("_blocks")).cast("int"), hi: F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))})
    x, y = side(left, a, "_lo", "_hi").drop("_blocks"), side(right, b, "_hi", "_lo").drop("_blocks")
    return x.join(y, [*key, "_lo", "_hi"]).drop("_lo", "_hi")
