"""Neighbour enrichment of junctions: against a control repertoire, and against generation probabilities.

Neighbours are counted by key joins (see :mod:`.neighbours`); a junction that many samples hold is looked up in the control once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clonotype import SAMPLE, strip_allele
from ..sources.scratch import Scratch
from .association import fdr_bh
from .neighbours import near_pairs


@F.pandas_udf(T.DoubleType())
def poisson_tail(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= k) of Poisson counts, from the smaller side's terms."""

    def tail(n: int, m: float) -> float:
        if n <= 0:
            return 1.0
        if m <= 0:
            return 0.0
        if n > m:  # falling terms from n on
            i = np.arange(n, n + 60 + int(12 * math.sqrt(m + n)))
        else:  # what lies further below the mean adds less than 1e-17
            i = np.arange(max(0, min(n, int(m - 9 * math.sqrt(m)) - 60)), n)
        logs = i * math.log(m) - m - np.array([math.lgamma(x + 1) for x in i])
        part = float(np.exp(logs).sum())
        return min(1.0, part) if n > m else max(0.0, 1.0 - part)

    return pd.Series([tail(int(n), float(m)) for n, m in zip(k, mean, strict=True)], dtype="float64")


def _collapsed(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct junctions with the calls of their most abundant row and their summed counts."""
    best = F.max_by(F.struct("v_call", "j_call"), F.struct("duplicate_count", -F.col("ord"))).alias("_best")
    return df.where("junction_aa is not null").groupBy(*by, "junction_aa").agg(best, F.sum("duplicate_count").alias("duplicate_count")).select(*by, "junction_aa", "_best.v_call", "_best.j_call", "duplicate_count")


def _counted(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    return pairs.groupBy(*by, F.col("seq_a").alias("junction_aa")).agg(F.count("*").alias(name))


def tcrnet(df: DataFrame, control: DataFrame, *, scope: str = "1,0,0,1", exclude_exact: bool = True, sample: str = SAMPLE) -> DataFrame:
    """Neighbours of each junction in its sample and in a control (``junction_aa`` and optionally ``locus``), the number expected, p and q.

    Samples are scored by locus, rows without one left out; q is within a sample. A control without ``locus`` serves all. A
    junction doesn't count itself in its sample (unless ``exclude_exact`` is off), but does in the control.
    """
    own, shared = [sample, "locus"], ["locus"] if "locus" in control.columns else []
    located = df.withColumn("locus", F.substring("v_call", 1, 3)).where("length(v_call) >= 3")
    one = _collapsed(located, own)
    degree = _counted(near_pairs(one, one, keys=own, scope=scope), own, "_met")
    background = control.where("junction_aa is not null").select(*shared, "junction_aa").distinct()
    wanted = one.select("locus", "junction_aa").distinct()
    outside = _counted(near_pairs(wanted, background, keys=shared, scope=scope), shared, "n_control")
    sizes = one.groupBy(*own).agg(F.count("*").alias("_n"))
    total = background.groupBy(*shared).agg(F.count("*").alias("_m"))
    out = one.join(degree, [*own, "junction_aa"], "left").join(outside, [*shared, "junction_aa"], "left").join(sizes, own)
    out = out.join(total, shared, "left") if shared else out.crossJoin(F.broadcast(total))  # one row
    out = out.fillna(0, ["_met", "n_control", "_m"]).withColumn("n_neighbors", F.col("_met") - (1 if exclude_exact else 0))
    out = out.withColumn("E", F.col("_n") / F.greatest("_m", F.lit(1)) * F.col("n_control")).withColumn("p_enrichment", poisson_tail("n_neighbors", "E"))
    out = fdr_bh(out, "p_enrichment", "q_value", (sample,))
    return out.select(sample, "junction_aa", "v_call", "j_call", "duplicate_count", "n_neighbors", "n_control", "E", "p_enrichment", "q_value", "locus")


def alice(df: DataFrame, balls: DataFrame, *, scope: str = "1,0,0,1", selection: float = 9.41, min_degree: int = 3, min_count: int = 2, sample: str = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """Neighbours of each junction among the nucleotide clonotypes of its V and J gene, against what generation and selection let expect.

    ``balls``: ``junction_aa, v_call, j_call, pgen_ball``, the generation probability of a junction and all its neighbours (see
    :func:`immunoframe.operators.recombination.pgen_ball`). Junctions with fewer neighbours than ``min_degree`` (themselves
    included) are not tested; clonotypes below ``min_count`` take no part. Clonotypes are read once: sizes, pairs and degrees
    come from a written row for each junction of a sample and its genes.
    """
    scratch = scratch or Scratch(df.sparkSession, "alice")
    genes = [strip_allele(F.col(c)).alias(c) for c in ("v_call", "j_call")]
    group = [sample, "v_call", "j_call"]
    kept = df.where((F.col("duplicate_count") >= min_count) & F.col("junction_aa").isNotNull()).select(sample, *genes, "junction_aa", "duplicate_count")
    held = scratch.cut(kept.groupBy(*group, "junction_aa").agg(F.count("*").alias("_nt"), F.sum("duplicate_count").alias("duplicate_count")))
    sizes = held.groupBy(*group).agg(F.sum("_nt").alias("n_group"))
    pairs = near_pairs(held, held, keys=group, scope=scope)
    degree = pairs.join(held.select(*group, F.col("junction_aa").alias("seq_b"), "_nt"), [*group, "seq_b"]).groupBy(*group, F.col("seq_a").alias("junction_aa")).agg(F.sum("_nt").alias("n_neighbors"))
    out = held.join(degree, [*group, "junction_aa"]).where(F.col("n_neighbors") >= min_degree).join(sizes, group).join(balls, ["junction_aa", "v_call", "j_call"])
    out = out.withColumn("E", F.col("n_group") * selection * F.col("pgen_ball")).withColumn("p_enrichment", poisson_tail("n_neighbors", "E"))
    out = scratch.cut(out)  # read by the ranks of p and beside them
    out = fdr_bh(out, "p_enrichment", "q_value", (sample,))
    return out.select(sample, "junction_aa", "v_call", "j_call", "duplicate_count", "n_neighbors", "n_group", "pgen_ball", "E", "p_enrichment", "q_value", F.substring("v_call", 1, 3).alias("locus"))


def neighbour_similarity(a: DataFrame, b: DataFrame, *, scope: str = "1,0,0,1", tau: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``seq_a, seq_b, z``: near junctions with the kernel ``exp(-edits / tau)``; equal ones have 1, others none."""
    return near_pairs(a, b, keys=list(keys), scope=scope).withColumn("z", F.exp(-F.col("distance") / tau))


def similarity_overlap(a: DataFrame, b: DataFrame, *, metric: str = "cosine", scope: str = "1,0,0,1", tau: float = 1.0) -> DataFrame:
    """``similarity`` of two samples by the sparse kernel between their junctions: cosine, or Morisita's index, of p'Zq."""
    if metric not in ("cosine", "morisita"):
        raise ValueError(f"metric must be 'cosine' or 'morisita', not {metric!r}")
    p, q = (d.groupBy("junction_aa").agg(F.sum("frequency").alias("w")).where("junction_aa is not null") for d in (a, b))

    def product(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        pairs = neighbour_similarity(x, y, scope=scope, tau=tau)
        met = pairs.join(x.select(F.col("junction_aa").alias("seq_a"), F.col("w").alias("wa")), "seq_a").join(y.select(F.col("junction_aa").alias("seq_b"), F.col("w").alias("wb")), "seq_b")
        return met.agg(F.coalesce(F.sum(F.col("z") * F.col("wa") * F.col("wb")), F.lit(0.0)).alias(name))

    one = product(p, q, "ab").crossJoin(product(p, p, "aa")).crossJoin(product(q, q, "bb"))  # single rows
    below = F.sqrt(F.col("aa") * F.col("bb")) if metric == "cosine" else (F.col("aa") + F.col("bb")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("ab"), below), F.lit(0.0)).alias("similarity"))


def functional_diversity(df: DataFrame, q: tuple[int, ...] = (0, 1, 2), *, scope: str = "1,0,0,1", tau: float = 1.0, sample: str = SAMPLE, near: Callable[[DataFrame, DataFrame, tuple[str, ...]], DataFrame] | None = None) -> DataFrame:
    """``order_q, diversity`` and ``rao``: diversity that counts near junctions as partly the same (Leinster and Cobbold), by the sparse kernel or by ``near``."""
    p = df.where("junction_aa is not null").groupBy(sample, "junction_aa").agg(F.sum("frequency").alias("p"))
    p = p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(sample))).where("p > 0")
    pairs = near(p, p, (sample,)) if near else neighbour_similarity(p, p, scope=scope, tau=tau, keys=(sample,))
    zp = pairs.join(p.select(sample, F.col("junction_aa").alias("seq_b"), F.col("p").alias("_b")), [sample, "seq_b"]).groupBy(sample, F.col("seq_a").alias("junction_aa")).agg(F.sum(F.col("z") * F.col("_b")).alias("zp"))
    both = p.join(zp, [sample, "junction_aa"])
    value = lambda o: F.exp(-F.sum(F.col("p") * F.log("zp"))) if o == 1 else F.pow(F.sum(F.col("p") * F.pow("zp", F.lit(float(o - 1)))), 1 / (1 - o))
    one = both.groupBy(sample).agg((1 - F.sum(F.col("p") * F.col("zp"))).alias("rao"), *(value(o).alias(str(o)) for o in q))
    return one.unpivot([sample, "rao"], [str(o) for o in q], "order_q", "diversity").withColumn("order_q", F.col("order_q").cast("int"))


