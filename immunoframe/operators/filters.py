"""Row filters; unless told not to, each renormalises frequencies within its samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clonotype import RESIDUES, SAMPLE, recompute_frequency, segment_pattern, strip_allele

KEY = ("junction_aa", "v_call", "j_call")


def _done(df: DataFrame, renormalise: bool, by: tuple[str, ...]) -> DataFrame:
    return recompute_frequency(df, by) if renormalise else df


def productive_mask(df: DataFrame) -> Column:
    """By the annotation if there is one, else by stop and frame flags, else by the residues; null counts as unproductive."""
    if "productive" in df.columns:
        mask = F.col("productive").cast("boolean")
    elif {"stop_codon", "vj_in_frame"} <= set(df.columns):
        mask = ~F.col("stop_codon").cast("boolean") & F.col("vj_in_frame").cast("boolean")
    else:
        mask = ~F.col("junction_aa").rlike("[*atgc#~_?]")
    return F.coalesce(mask, F.lit(False))


def filter_productive(df: DataFrame, keep: str = "productive", *, renormalise: bool = True, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    mask = productive_mask(df)
    return _done(df.where(mask if keep == "productive" else ~mask), renormalise, by)


def filter_functional(df: DataFrame, keep: str = "coding", **options) -> DataFrame:
    return filter_productive(df, "productive" if keep == "coding" else "unproductive", **options)


def filter_functional_genes(df: DataFrame, germline: DataFrame, *, segments: tuple[str, ...] = ("V", "J"), keep: tuple[str, ...] = ("F",), renormalise: bool = True, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Keeps rows whose genes have an allele of a kept class (``germline``: ``gene, functional``); unknown genes stay."""
    for s in segments:
        column = f"{s.lower()}_call"
        ok = germline.groupBy("gene").agg(F.bool_or(F.col("functional").isin(*keep)).alias("_ok")).select(F.col("gene").alias("_gene"), "_ok")
        df = df.withColumn("_gene", F.regexp_replace(F.trim(column), r"\*.*$", "")).join(ok, "_gene", "left").where(F.coalesce("_ok", F.lit(True))).drop("_gene", "_ok")
    return _done(df, renormalise, by)


def filter_length(df: DataFrame, low: int = 5, high: int = 60, keep: str = "within", *, renormalise: bool = True, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    inside = F.coalesce(F.length("junction_aa").between(low, high), F.lit(False))
    return _done(df.where(inside if keep == "within" else ~inside), renormalise, by)


def filter_frequency(df: DataFrame, min_freq: float | None = None, top: float | None = None, *, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Rows of at least ``min_freq``; of these, in falling order of counts, those within the share ``top`` of the whole sample."""
    df = df.withColumn("_all", F.sum("frequency").over(Window.partitionBy(*by)))
    if min_freq is not None:
        df = df.where(F.col("frequency") >= min_freq)
    if top is not None:
        w = Window.partitionBy(*by).orderBy(F.desc("duplicate_count"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("_cum", F.sum("frequency").over(w)).where(F.col("_cum") <= top * F.col("_all") + 1e-12).drop("_cum")
    return recompute_frequency(df.drop("_all"), by)


def filter_segment(df: DataFrame, v=None, d=None, j=None, keep: bool = True, *, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Calls that begin with given names, in every segment asked for; a null call is dropped either way, unless another segment already fails."""
    mask = F.lit(True)
    for column, names in (("v_call", v), ("d_call", d), ("j_call", j)):
        if names is not None:
            mask = mask & F.col(column).rlike(segment_pattern(names))
    return recompute_frequency(df.where(mask if keep else ~mask), by)


def filter_by_sample(df: DataFrame, other: DataFrame, keep: bool = True, key: tuple[str, ...] = KEY, *, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    return recompute_frequency(df.join(other.select(*key).distinct(), list(key), "left_semi" if keep else "left_anti"), by)


def decontaminate(df: DataFrame, *, ratio: float = 20.0, measure: str = "freq", key: tuple[str, ...] = ("junction_nt", "v_call", "j_call"), sample: str = SAMPLE) -> DataFrame:
    """Drops a sample's clonotype if another sample holds at least ``ratio`` times as much of it.

    One pass over the cohort: the largest and second largest sum of each key tell every sample the largest of the others.
    """
    value = F.col("frequency") if measure == "freq" else F.col("duplicate_count")
    sums = df.groupBy(sample, *key).agg(F.sum(value).alias("_own"))
    w = Window.partitionBy(*key).orderBy(F.desc("_own"), sample)
    ranked = sums.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    top = ranked.groupBy(*key).agg(F.max(F.when(F.col("_r") == 1, F.col("_own"))).alias("_m1"), F.max(F.when(F.col("_r") == 1, F.col(sample))).alias("_s1"), F.max(F.when(F.col("_r") == 2, F.col("_own"))).alias("_m2"))
    joined = df.join(top, list(key), "left")
    others = F.when(F.col(sample) == F.col("_s1"), F.col("_m2")).otherwise(F.col("_m1"))
    return recompute_frequency(joined.where(others.isNull() | (others < ratio * value)).select(*df.columns), (sample,))


def unparsable(df: DataFrame) -> DataFrame:
    """Junctions with characters outside the residues, ``*`` and ``_``."""
    return df.where(F.col("junction_aa").rlike(f"[^{RESIDUES}*_]"))


def assert_parseable(df: DataFrame) -> DataFrame:
    """The rows, failing at run time where a junction cannot be read."""
    bad = F.col("junction_aa").rlike(f"[^{RESIDUES}*_]")
    return df.withColumn("junction_aa", F.when(bad, F.raise_error(F.concat(F.lit("unreadable junction: "), "junction_aa")).cast("string")).otherwise(F.col("junction_aa")))


def sanitise(df: DataFrame, *, by: tuple[str, ...] = (SAMPLE,)) -> tuple[DataFrame, DataFrame]:
    """Rows with a positive count and an anchored junction of residues, and by sample the share of counts dropped."""
    good = F.coalesce((F.col("duplicate_count") > 0) & F.col("junction_aa").rlike(f"^C[{RESIDUES}]*[FW]$"), F.lit(False))
    dropped = df.groupBy(*by).agg((F.sum(F.when(~good, F.col("duplicate_count")).otherwise(0)) / F.sum("duplicate_count")).alias("dropped"))
    return df.where(good), dropped


def strip_calls(df: DataFrame) -> DataFrame:
    return df.withColumn("v_call", strip_allele(F.col("v_call"))).withColumn("j_call", strip_allele(F.col("j_call")))
