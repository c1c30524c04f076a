"""Batch correction of V/J usage, and its application to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clonotype import SAMPLE, strip_allele
from ..sources.scratch import Scratch
from .filters import strip_calls

GENES = ("v_call", "j_call")


def _clipped(df: DataFrame, column: str, by: list[str], share: float | None) -> DataFrame:
    """``column`` with its tails within ``by`` set to their quantiles."""
    if share is None:
        return df
    ends = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(share), F.lit(1 - share))).alias("_ends"))
    return df.join(ends, by).withColumn(column, F.least(F.greatest(column, F.col("_ends")[0]), F.col("_ends")[1])).drop("_ends")


def _moments(df: DataFrame, by: list[str], share: float | None, **names: Column) -> DataFrame:
    return _clipped(df.select("log_p", *by), "log_p", by, share).groupBy(*by).agg(*(c.alias(n) for n, c in names.items()))


def correct_vj_usage(
    df: DataFrame, batch: str = "batch", *, weighted: bool = True, pseudocount: float = 1.0, transform: str = "location", z_cap: float = 6.0, winsor: float | None = None, sample: str = SAMPLE
) -> DataFrame:
    """``sample_id, batch, locus, v_call, j_call, count, p, p_corrected`` for every sample and every gene pair of its loci.

    ``location`` moves each batch's mean log usage of a pair to that of all samples; ``sigmoid`` maps a sample's deviation within
    its batch onto twice the pooled usage. Both are scaled to 1 within sample and locus.
    """
    if transform not in ("location", "sigmoid"):
        raise ValueError(f"transform must be 'location' or 'sigmoid', not {transform!r}")
    own, pair = [sample, batch, "locus"], ["locus", *GENES]
    rows = strip_calls(df).withColumn("locus", F.substring("v_call", 1, 3))
    usage = rows.groupBy(*own, *GENES).agg((F.sum("duplicate_count") if weighted else F.count("*")).alias("count"))
    usage = Scratch(df.sparkSession, "vj-usage").cut(usage)  # genes of samples, read often
    grid = usage.select(*own).distinct().join(usage.select(*pair).distinct(), "locus")  # the result has this many rows
    within = Window.partitionBy(sample, "locus")
    full = grid.join(usage, [*own, *GENES], "left").fillna(0, ["count"])
    full = full.withColumn("p", (F.col("count") + pseudocount) / F.sum(F.col("count") + pseudocount).over(within)).withColumn("log_p", F.log("p"))
    if transform == "location":
        full = full.join(_moments(full, [*pair, batch], winsor, _own=F.avg("log_p")), [*pair, batch]).join(_moments(full, pair, winsor, _all=F.avg("log_p")), pair)
        raw = F.exp(F.col("log_p") - F.col("_own") + F.col("_all"))
    else:
        full = full.join(_moments(full, [*pair, batch], winsor, _own=F.avg("log_p"), _sd=F.stddev_samp("log_p")), [*pair, batch])
        pooled = full.groupBy(*pair).agg(F.sum("count").alias("_n")).withColumn("_avg", F.try_divide("_n", F.sum("_n").over(Window.partitionBy("locus"))))
        full = full.join(pooled.drop("_n"), pair)
        z = F.when(F.col("_sd") > 0, (F.col("log_p") - F.col("_own")) / F.col("_sd")).otherwise(0.0)
        raw = 2 * F.col("_avg") / (1 + F.exp(-F.greatest(F.least(z, F.lit(z_cap)), F.lit(-z_cap))))
    full = full.withColumn("_raw", raw)
    total = F.sum("_raw").over(within)
    corrected = F.when(total > 0, F.col("_raw") / total).otherwise(F.col("p") / F.sum("p").over(within))
    return full.select(F.col(sample).alias(SAMPLE), F.col(batch).alias("batch"), *pair, "count", "p", corrected.alias("p_corrected"))


def gene_factors(usage: DataFrame, scope: str = "vj") -> DataFrame:
    """``factor``: corrected over raw usage by sample and locus, of pairs (``vj``) or of the genes of one segment (``v``, ``j``)."""
    genes = {"vj": list(GENES), "v": ["v_call"], "j": ["j_call"]}[scope]
    return usage.groupBy(SAMPLE, "locus", *genes).agg((F.sum("p_corrected") / F.sum("p")).alias("factor"))


def apply_vj_correction(df: DataFrame, usage: DataFrame, *, scope: str = "vj", sample: str = SAMPLE) -> DataFrame:
    """Rows with counts reweighted by their genes' factors, whole and with each sample's total kept: the largest remainders are rounded up.

    Rows of genes without a factor keep their weight; rows left with no count go.
    """
    genes = {"vj": list(GENES), "v": ["v_call"], "j": ["j_call"]}[scope]
    factors = gene_factors(usage, scope).select(F.col(SAMPLE).alias(sample), "locus", *(F.col(g).alias(f"_{g}") for g in genes), "factor")
    rows = df.withColumn("locus", F.substring("v_call", 1, 3)).withColumns({f"_{g}": strip_allele(F.col(g)) for g in genes})
    rows = rows.join(factors, [sample, "locus", *(f"_{g}" for g in genes)], "left")
    all_ = Window.partitionBy(sample)
    share = F.col("duplicate_count") * F.coalesce("factor", F.lit(1.0))
    rows = rows.withColumn("_w", share).withColumn("_x", F.col("_w") / F.sum("_w").over(all_) * F.sum("duplicate_count").over(all_)).withColumn("_low", F.floor("_x"))
    rows = rows.withColumn("_left", F.sum("duplicate_count").over(all_) - F.sum("_low").over(all_))
    order = Window.partitionBy(sample).orderBy(F.desc(F.round(F.col("_x") - F.col("_low"), 9)), "ord")
    count = (F.col("_low") + (F.row_number().over(order) <= F.col("_left")).cast("int")).cast("long")
    rows = rows.withColumn("duplicate_count", count).where("duplicate_count > 0")
    return rows.withColumn("frequency", F.col("duplicate_count") / F.sum("duplicate_count").over(all_)).select(*df.columns)
