"""Segment usage, length spectra and somatic hypermutation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clonotype import SAMPLE, isotype, strip_allele, weight


def _by(df: DataFrame, by_locus: bool, by: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    return (df.withColumn("locus", F.substring("v_call", 1, 3)), [*by, "locus"]) if by_locus else (df, list(by))


def segment_usage(df: DataFrame, segment: str, kind: str = "reads", *, by_locus: bool = True, keep_allele: bool = False, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    column = f"{segment.lower()}_call"
    df, keys = _by(df.where(F.col(column).isNotNull()), by_locus, by)
    call = F.col(column) if keep_allele else strip_allele(F.col(column))
    return df.groupBy(*keys, call.alias(column)).agg(F.sum(weight(kind)).alias("weight"))


def vj_usage(df: DataFrame, kind: str = "reads", *, by_locus: bool = True, keep_allele: bool = False, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    df, keys = _by(df.where("v_call is not null and j_call is not null"), by_locus, by)
    calls = [(F.col(c) if keep_allele else strip_allele(F.col(c))).alias(c) for c in ("v_call", "j_call")]
    return df.groupBy(*keys, *calls).agg(F.sum(weight(kind)).alias("weight"))


def spectratype(df: DataFrame, of: str = "aa", kind: str = "reads", *, by_locus: bool = True, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    df, keys = _by(df, by_locus, by)
    n = F.length(f"junction_{of}")
    return df.where(n > 0).groupBy(*keys, n.alias("length")).agg(F.sum(weight(kind)).alias("weight"))


def vj_spectratype(df: DataFrame, of: str = "aa", kind: str = "reads", *, by_locus: bool = True, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    df, keys = _by(df, by_locus, by)
    n = F.length(f"junction_{of}")
    calls = [strip_allele(F.col(c)).alias(c) for c in ("v_call", "j_call")]
    return df.where((n > 0) & F.col("v_call").isNotNull() & F.col("j_call").isNotNull()).groupBy(*keys, *calls, n.alias("length")).agg(F.sum(weight(kind)).alias("weight"))


def _bin(bins: int):
    return F.least(F.floor(F.col("v_identity") * bins), F.lit(bins - 1)).cast("int")


def shm_spectrum(df: DataFrame, kind: str = "freq", bins: int = 20, *, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Weight by identity bin on [0, 1], the last one closed, empty bins included."""
    held = df.where("v_identity between 0 and 1").groupBy(*by, _bin(bins).alias("bin")).agg(F.sum(weight(kind)).alias("weight"))
    grid = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(held, [*by, "bin"], "left").select(*by, "bin", (F.col("bin") / bins).alias("low"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))


def shm_summary(df: DataFrame, kind: str = "freq", *, mutated_below: float = 0.98, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Weighted identity, mutated and switched shares and the entropy of identities; NaN where nothing was measured."""
    w = weight(kind).cast("double")
    seen, iso = F.col("v_identity").isNotNull(), isotype(F.col("c_call"))
    x = df.withColumn("_w", w).withColumn("_i", F.when(seen, F.col("_w"))).withColumn("_c", F.when(F.col("c_call").isNotNull(), F.col("_w")))
    nan = F.lit(float("nan"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), nan)
    base = x.groupBy(*by).agg(
        share(F.sum(F.col("_i") * F.col("v_identity")), F.sum("_i")).alias("mean_identity"), share(F.sum(F.col("_i") * F.col("v_identity") * F.col("v_identity")), F.sum("_i")).alias("_m2"),
        share(F.sum(F.when(F.col("v_identity") < mutated_below, F.col("_i")).otherwise(F.col("_i") * 0)), F.sum("_i")).alias("frac_mutated"),
        share(F.sum(F.when(~iso.isin("IGHM", "IGHD"), F.col("_c")).otherwise(F.col("_c") * 0)), F.sum("_c")).alias("frac_switched"),
    )
    bins = x.where(seen).groupBy(*by, _bin(20).alias("bin")).agg(F.sum("_w").alias("b")).withColumn("p", F.col("b") / F.sum("b").over(Window.partitionBy(*by)))
    entropy = bins.groupBy(*by).agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p"))).alias("entropy"))
    out = base.join(entropy, list(by), "left").withColumn("entropy", F.coalesce("entropy", nan))
    return out.withColumn("sd_identity", F.sqrt(F.greatest(F.col("_m2") - F.col("mean_identity") * F.col("mean_identity"), F.lit(0.0)))).drop("_m2")


def shm_entropy(df: DataFrame, kind: str = "freq", bins: int = 20, *, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """``entropy`` (natural) of the weighted identities in equal bins from 0 to 1; 1 is in the last one."""
    of = df.where("v_identity is not null").groupBy(*by, F.least(F.floor(F.col("v_identity") * bins), F.lit(bins - 1)).alias("_bin")).agg(F.sum(weight(kind)).cast("double").alias("_w"))
    p = F.col("_w") / F.sum("_w").over(Window.partitionBy(*by))
    return of.withColumn("_p", p).where("_p > 0").groupBy(*by).agg(F.sum(-F.col("_p") * F.log("_p")).alias("entropy"))
