"""Pooling, joining and tracking clonotypes over samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clonotype import SAMPLE

#: Named match keys.
KEYS = {
    "strict": ("junction_nt", "junction_aa", "v_call", "j_call"), "nt": ("junction_nt",), "ntV": ("junction_nt", "v_call"), "ntVJ": ("junction_nt", "v_call", "j_call"),
    "aa": ("junction_aa",), "aaV": ("junction_aa", "v_call"), "aaVJ": ("junction_aa", "v_call", "j_call"),
}


def resolve_key(key: str) -> tuple[str, ...]:
    try:
        return KEYS[key]
    except KeyError:
        raise ValueError(f"key must be one of {', '.join(KEYS)}, not {key!r}") from None


def pool_samples(df: DataFrame, key: str = "aa", sample: str = SAMPLE, *, reads: DataFrame | None = None) -> DataFrame:
    """Per key: summed counts, samples, rows, distinct rearrangements, and the columns of the most abundant row.

    Rows of a sample and key are combined first, so that no row is copied for a distinct count; a key that holds the whole
    rearrangement has one. ``reads``: a table with the same ``duplicate_count`` in all, if one is cheaper to add up than ``df``.
    """
    columns = resolve_key(key)
    rest = [c for c in ("v_call", "d_call", "j_call", "junction_aa", "junction_nt") if c not in columns]
    best = F.max_by(F.struct(*rest), F.struct("duplicate_count", -F.col("ord"))).alias("_b")
    whole = ("junction_nt", "v_call", "j_call")
    if set(whole) <= set(columns):
        per = df.groupBy(*columns, sample).agg(F.sum("duplicate_count").alias("_n"), F.count("*").alias("_rows"), F.max(F.struct("duplicate_count", -F.col("ord"), F.struct(*rest))).alias("_m"))
        out = per.groupBy(*columns).agg(F.sum("_n").alias("duplicate_count"), F.count(sample).alias("incidence"), F.sum("_rows").alias("occurrences"), F.lit(1).cast("long").alias("convergence"), F.max("_m").alias("_m"))
        out = out.withColumn("_b", F.col("_m.col3")).drop("_m")
    else:
        out = df.groupBy(*columns).agg(
            F.sum("duplicate_count").alias("duplicate_count"), F.countDistinct(sample).alias("incidence"), F.count("*").alias("occurrences"),
            F.countDistinct(F.struct(*whole)).alias("convergence"), best,
        )
    total = (df if reads is None else reads).agg(F.sum("duplicate_count").alias("_all"))  # one row
    frequency = F.try_divide(F.col("duplicate_count").cast("double"), F.col("_all")).alias("frequency")
    return out.crossJoin(F.broadcast(total)).select(*columns, *(F.col(f"_b.{c}").alias(c) for c in rest), "duplicate_count", frequency, "incidence", "occurrences", "convergence")


def join_samples(df: DataFrame, key: str = "aa", min_samples: int = 2, sample: str = SAMPLE, n_samples: int | None = None) -> DataFrame:
    """Clonotypes of at least ``min_samples`` samples with their joint frequency (a jittered geometric mean) and count.

    Samples that lack a clonotype count as frequency 0, without an n-way join: the sum over samples that hold it is
    completed by the logarithm of the jitter for each that doesn't.
    """
    columns = list(resolve_key(key))
    jitter = 1e-9
    per = df.groupBy(*columns, sample).agg(F.sum("frequency").alias("f"))
    joint = per.groupBy(*columns).agg(F.count("*").alias("incidence"), F.sum(F.log(F.col("f") + jitter)).alias("_l"))
    if n_samples:
        joint, n = joint.withColumn("_n", F.lit(n_samples)), F.col("_n")
    else:
        joint, n = joint.crossJoin(F.broadcast(df.agg(F.countDistinct(sample).alias("_n")))), F.col("_n")  # one row
    joint = joint.where(F.col("incidence") >= min_samples).withColumn("_g", F.exp((F.col("_l") + (n - F.col("incidence")) * math.log(jitter)) / n))
    totals = joint.agg(F.sum("_g").alias("_t"), F.min("_g").alias("_m"))  # one row
    out = joint.crossJoin(F.broadcast(totals))
    return out.select(*columns, "incidence", (F.col("_g") / F.col("_t")).alias("frequency"), F.floor(F.col("_g") / F.col("_m") + 1e-9).alias("duplicate_count"))


def track_clonotypes(df: DataFrame, order: list[str], top: int | None = None, key: tuple[str, ...] = ("junction_aa", "v_call", "j_call"), sample: str = SAMPLE) -> DataFrame:
    """Frequencies by sample as columns, ``freq_sum``, in falling order."""
    per = df.where(F.col(sample).isin(order)).groupBy(*key, sample).agg(F.sum("frequency").alias("f"))
    wide = per.groupBy(*key).pivot(sample, order).agg(F.first("f")).fillna(0.0, subset=order)
    wide = wide.withColumn("freq_sum", sum((F.col(c) for c in order), F.lit(0.0)))
    ranked = wide.orderBy(F.desc("freq_sum"), *key)
    return ranked.limit(top) if top else ranked
