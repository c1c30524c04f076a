"""Similarity kernels with residue penalties and one gap block.

Two junctions are aligned with at most one block of gaps, as long as they differ in length. The penalty of a pair is the sum of
the penalties of its residues and, with a block of ``D`` letters after ``p`` letters of the shorter one, ``gap_open + (D - 1)
gap_extend + prior |p - anchor|``, at the best ``p``; the anchor is the middle (``central``) or the start (``frame``). The kernel is
``exp(-penalty / tau)`` up to a greatest penalty, and 0 beyond.

Pairs come from a filter that loses none: letters that little penalty parts are one group, chosen so that a change of
group costs at least some ``t``; a pair within ``most`` then differs by at most ``most / t`` groups, which is a near match
of reduced strings (see :mod:`.neighbours`). Longer sequences come with each block left out, and have less left for residues. What pairs beyond ``most`` would add
is bounded by ``exp(-most / tau)`` times the weights they have, so that sums come with bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clonotype import SAMPLE
from .enrichment import functional_diversity
from .features import HYDROPATHY, VOLUME
from .neighbours import _substituted

Penalties = dict[tuple[str, str], float]


def penalties_from_scores(scores: dict[tuple[str, str], float]) -> Penalties:
    """Penalties ``s(a, a) + s(b, b) - 2 s(a, b)`` of a symmetric matrix of alignment scores."""
    letters = sorted({a for a, _ in scores})
    return {(a, b): max(0.0, scores[a, a] + scores[b, b] - 2 * scores[a, b]) for a in letters for b in letters}


def read_scores(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """A matrix of alignment scores as text: letters in the first row and column, lines with ``#`` are notes."""
    text = spark.read.text(path, wholetext=True).first()[0]  # some twenty-five rows
    head, *rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {(row[0], b): float(x) for row in rows for b, x in zip(head, row[1:], strict=True)}


def penalties_from_scales(steps: tuple[tuple[dict[str, float], float], ...] = ((HYDROPATHY, 1.0), (VOLUME, 40.0))) -> Penalties:
    """Whole steps by which two residues differ on each scale, summed; 1 at least for different residues."""
    letters = sorted(set.intersection(*(set(s) for s, _ in steps)))
    return {(a, b): 0.0 if a == b else max(1.0, sum(math.floor(abs(s[a] - s[b]) / step) for s, step in steps)) for a in letters for b in letters}


def _groups(penalties: Penalties, below: float) -> dict[str, str]:
    """Each letter's group, by its least letter: letters that steps of less than ``below`` connect."""
    letters = sorted({a for a, _ in penalties})
    of = {a: a for a in letters}
    for _ in letters:
        of = {a: min(of[b] for b in letters if a == b or min(penalties[a, b], penalties[b, a]) < below) for a in letters}
    return of


def _filter(penalties: Penalties, most: float) -> tuple[dict[str, str], int]:
    """Groups of letters and the changes of group that a pair within ``most`` can have, where chance pairs are fewest."""
    best = None
    for t in sorted({p for p in penalties.values() if p > 0}):
        groups, k = _groups(penalties, t), int(most // t)
        sizes = [list(groups.values()).count(g) for g in set(groups.values())]
        worth = -math.log(sum((n / len(groups)) ** 2 for n in sizes)) / (k + 1)
        if best is None or worth > best[0]:
            best = (worth, groups, k)
    return (best[1], best[2]) if best else ({}, 0)


def _penalty(penalties: Penalties, most: float, gap_open: float, gap_extend: float, prior: float, anchor: float):
    table = np.full((128, 128), max(penalties.values(), default=1.0))
    for (a, b), p in penalties.items():
        table[ord(a), ord(b)] = p

    def costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(a == b, 0.0, table[np.minimum(a, 127), np.minimum(b, 127)])

    def one(x: np.ndarray, y: np.ndarray) -> float:
        gap, n = abs(len(x) - len(y)), min(len(x), len(y))
        if not gap:
            return float(costs(x, y).sum())
        before = np.concatenate([[0.0], np.cumsum(costs(x[:n], y[:n]))])
        after = np.concatenate([[0.0], np.cumsum(costs(x[len(x) - n :], y[len(y) - n :])[::-1])])[::-1]
        return float((before + after + prior * np.abs(np.arange(n + 1) - anchor * n)).min()) + gap_open + (gap - 1) * gap_extend

    @F.pandas_udf(T.DoubleType())
    def penalty(a: pd.Series, b: pd.Series) -> pd.Series:
        letters = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
        out = np.array([one(letters(x), letters(y)) for x, y in zip(a, b, strict=True)], np.float64)
        return pd.Series(np.where(out <= most, out, np.nan)).astype(object).where(out <= most, None)

    return penalty


def penalised_pairs(a: DataFrame, b: DataFrame, *, penalties: Penalties | None = None, most: float = 4.0, gap_open: float = 3.0, gap_extend: float = 1.0, prior: float = 0.5, placement: str = "central", keys: tuple[str, ...] = ()) -> DataFrame:
    """``seq_a, seq_b, penalty``: all pairs of distinct junctions within ``keys`` whose penalty is at most ``most``.

    Letters that the penalties don't name cost as much as the worst, unless equal. Null junctions take no part; equal ones have
    penalty 0. ``gap_open`` above ``most`` rules gaps out.
    """
    if placement not in ("central", "frame", "none"):
        raise ValueError(f"placement must be 'central', 'frame' or 'none', not {placement!r}")
    if gap_extend <= 0:
        raise ValueError("gap_extend must be positive")
    penalties, keys = penalties_from_scales() if penalties is None else penalties, list(keys)
    prior, anchor = (0.0, 0.0) if placement == "none" else (prior, 0.5 if placement == "central" else 0.0)
    longest = int((most - gap_open) // gap_extend) + 1 if gap_open <= most else 0

    def side(df: DataFrame, name: str, sign: int, gaps: range, groups: dict[str, str]) -> DataFrame:
        """Sequences with ``_d``, how much longer ``a`` is than ``b``, and ``_r``, reduced strings of the length of the shorter one."""
        seq, n = F.col(name), F.length(name)

        def without(d: int):  # each block of d letters left out
            at = F.when(n >= d, F.sequence(F.lit(0), n - d)).otherwise(F.array().cast("array<int>"))
            near = F.filter(at, lambda p: F.abs(p - F.lit(anchor) * (n - d)) * prior <= most - gap_open - (d - 1) * gap_extend)
            return F.transform(near, lambda p: F.struct(F.lit(sign * d).alias("_d"), F.concat(F.substring(seq, F.lit(1), p), F.substring(seq, p + d + 1, n)).alias("_r")))

        whole = F.array(*(F.struct(F.lit(-sign * d).alias("_d"), seq.alias("_r")) for d in gaps))
        forms = F.concat(whole, *(without(d) for d in gaps if d))
        held = df.select(*keys, F.col("junction_aa").alias(name)).where(seq.isNotNull()).distinct()
        forms = held.withColumn("_x", F.explode(forms)).select(*keys, name, "_x.*")
        return forms.withColumn("_r", F.translate("_r", "".join(groups), "".join(groups.values()))).distinct()

    def candidates(gaps: range, left: float) -> DataFrame:
        """Pairs that such gaps and ``left`` for residues allow."""
        groups, k = _filter(penalties, left)
        x, y, within = side(a, "seq_a", 1, gaps, groups), side(b, "seq_b", -1, gaps, groups), [*keys, "_d"]
        one, two = (d.select(*within, F.col("_r").alias(s)).distinct() for d, s in ((x, "seq_a"), (y, "seq_b")))
        met = _substituted(one, two, k, within, True).select(*within, F.col("seq_a").alias("_ra"), F.col("seq_b").alias("_rb"))
        found = met.join(x.withColumnRenamed("_r", "_ra"), [*within, "_ra"]).join(y.withColumnRenamed("_r", "_rb"), [*within, "_rb"])
        return found.select(*keys, "seq_a", "seq_b")

    found = candidates(range(1), most)
    if longest:
        # Dealt anew, as a union of equally dealt tables must not pass for one table so dealt.
        found = found.unionByName(candidates(range(1, longest + 1), most - gap_open)).repartition(*keys, "seq_a", "seq_b")
    found = found.distinct()
    return found.withColumn("penalty", _penalty(penalties, most, gap_open, gap_extend, prior, anchor)("seq_a", "seq_b")).where("penalty is not null")


def kernel(*, tau: float = 2.0, step: bool = False, **scoring) -> Callable[[DataFrame, DataFrame, tuple[str, ...]], DataFrame]:
    """``seq_a, seq_b, z`` of two samples: ``exp(-penalty / tau)``, or 1 with ``step``, within the greatest penalty."""

    def pairs(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        return penalised_pairs(a, b, keys=keys, **scoring).withColumn("z", F.lit(1.0) if step else F.exp(-F.col("penalty") / tau))

    return pairs


def residue_overlap(a: DataFrame, b: DataFrame, *, metric: str = "cosine", tau: float = 2.0, most: float = 4.0, **scoring) -> DataFrame:
    """``similarity`` of two samples by the kernel within ``most``, and bounds ``low, high`` of what it is by the kernel of all pairs."""
    if metric not in ("cosine", "morisita"):
        raise ValueError(f"metric must be 'cosine' or 'morisita', not {metric!r}")
    p, q = (d.where("junction_aa is not null").groupBy("junction_aa").agg(F.sum("frequency").alias("w")) for d in (a, b))
    near = kernel(tau=tau, most=most, **scoring)

    def product(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        """The product, and with what all other pairs can add at most."""
        met = near(x, y, ()).join(x.select(F.col("junction_aa").alias("seq_a"), F.col("w").alias("wa")), "seq_a").join(y.select(F.col("junction_aa").alias("seq_b"), F.col("w").alias("wb")), "seq_b")
        both = met.agg(F.coalesce(F.sum(F.expr("z * wa * wb")), F.lit(0.0)).alias(name), F.coalesce(F.sum(F.expr("wa * wb")), F.lit(0.0)).alias("_met"))
        total = x.agg(F.sum("w").alias("_x")).crossJoin(y.agg(F.sum("w").alias("_y")))  # single rows
        rest = F.greatest(F.coalesce(F.expr("_x * _y"), F.lit(0.0)) - F.col("_met"), F.lit(0.0))
        return both.crossJoin(total).select(name, (F.col(name) + math.exp(-most / tau) * rest).alias(name + "_high"))

    one = product(p, q, "ab").crossJoin(product(p, p, "aa")).crossJoin(product(q, q, "bb"))  # single rows
    below = lambda h: F.sqrt(F.col("aa" + h) * F.col("bb" + h)) if metric == "cosine" else (F.col("aa" + h) + F.col("bb" + h)) / 2
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return one.select(ratio(F.col("ab"), below("")).alias("similarity"), ratio(F.col("ab"), below("_high")).alias("low"), ratio(F.col("ab_high"), below("")).alias("high"))


def residue_diversity(df: DataFrame, q: tuple[int, ...] = (0, 1, 2), *, sample: str = SAMPLE, **scoring) -> DataFrame:
    """:func:`.enrichment.functional_diversity` by the kernel with residue penalties and gaps."""
    return functional_diversity(df, q, sample=sample, near=kernel(**scoring))
