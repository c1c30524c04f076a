"""Change of clonotypes between two samples: effective size, exact tests, expansion, and recapture by size class.

Two samples meet in one full join. What the tests need besides a clonotype's own counts are aggregates: binned variances,
totals, quantiles and histograms of equal counts. Exact tests run on distinct tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clonotype import size_class
from ..sources.scratch import Scratch
from .association import fdr_bh, fisher_p
from .neighbours import metaclonotypes
from .ranks import quantiles

KEY = ("junction_aa", "v_call", "j_call")


def joined(a: DataFrame, b: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Counts and frequencies of every clonotype of either sample, 0 where it is missing: ``count_a, count_b, f_a, f_b``."""
    x, y = (d.groupBy(*key).agg(F.sum("duplicate_count").alias(f"count_{s}")) for d, s in ((a, "a"), (b, "b")))
    out = x.join(y, list(key), "full").fillna(0, ["count_a", "count_b"])
    totals = out.agg(F.sum("count_a").alias("_a"), F.sum("count_b").alias("_b"))  # one row
    share = lambda s: F.coalesce(F.try_divide(F.col(f"count_{s}").cast("double"), F.col(f"_{s}")), F.lit(0.0)).alias(f"f_{s}")
    return out.crossJoin(F.broadcast(totals)).select(*key, "count_a", "count_b", share("a"), share("b"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _poisson_band(n: pd.Series, mean: pd.Series) -> pd.Series:
    """The counts beyond which fewer than one of ``n`` Poisson counts is expected: quantiles 1 / 2n and 1 - 1 / 2n."""

    def quantile(p: float, lam: float) -> float:
        at = max(0, int(lam - 12 * math.sqrt(lam) - 12)) if lam > 400 else 0
        k = np.arange(at, int(lam + 14 * math.sqrt(lam) + 40) + 1)
        log_pmf = k * math.log(lam) - lam - np.array([math.lgamma(x + 1) for x in k]) if lam > 0 else np.where(k == 0, 0.0, -np.inf)
        return float(k[min(len(k) - 1, int(np.searchsorted(np.cumsum(np.exp(log_pmf)), p * (1 - 1e-13))))])

    return pd.Series([[quantile(1 / (2 * m), x), quantile(1 - 1 / (2 * m), x)] for m, x in zip(n, mean, strict=True)])


def _binned(pairs: DataFrame, bins: int) -> DataFrame:
    """``pairs`` with their mean frequency ``mid`` and its bin, of bins in even steps of its logarithm."""
    pairs = pairs.withColumn("mid", (F.col("f_a") + F.col("f_b")) / 2)
    ends = pairs.agg(F.log(F.min("mid")).alias("_lo"), F.log(F.max("mid")).alias("_hi"))  # one row
    at = F.floor((F.log("mid") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    return pairs.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), F.least(at, F.lit(bins - 1))).otherwise(bins - 1)).drop("_lo", "_hi")


def _fit(pairs: DataFrame, bins: int, min_bin: int) -> float:
    """The size at which sampling alone gives the variances of the bins, from the mean of their logarithms by clonotypes."""
    per = _binned(pairs, bins).groupBy("bin").agg(F.count("*").alias("n"), F.var_samp(F.col("f_a") - F.col("f_b")).alias("v"), F.avg("mid").alias("m")).where(f"n >= {min_bin} and v > 0 and m > 0")
    r = per.agg(F.count("*").alias("bins"), (F.sum(F.col("n") * (F.log("v") - F.log(2 * F.col("m")))) / F.sum("n")).alias("beta")).first()
    if r["bins"] < 2:
        raise ValueError("the pair is too shallow, or shares too few clonotypes, for an effective size: fewer than two usable bins")
    return math.exp(-r["beta"])


def estimate_neff(a: DataFrame, b: DataFrame, *, key: tuple[str, ...] = KEY, min_count: int = 2, bins: int = 25, min_bin: int = 10, ref_n: float | None = None) -> float:
    """The effective size of a pair: as if both were samples of so many cells. Clonotypes beyond Poisson noise of the bin don't count."""
    pairs = joined(a, b, key)
    totals = pairs.agg(F.least(F.sum("count_a"), F.sum("count_b")).alias("_n"))  # one row
    pairs = pairs.crossJoin(F.broadcast(totals)).where(f"(f_a + f_b) / 2 > {min_count} / greatest(_n, 1)").select("f_a", "f_b").persist()
    try:
        if pairs.isEmpty():
            raise ValueError("no clonotype is frequent enough; the pair is too shallow")
        size = ref_n or _fit(pairs, bins, min_bin)
        placed = _binned(pairs, bins)
        band = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("mid").alias("m")).withColumn("band", _poisson_band("n", F.col("m") * size))
        inside = " and ".join(f"{f} * {size!r} between band[0] and band[1]" for f in ("f_a", "f_b"))
        kept = placed.join(F.broadcast(band.select("bin", "n", "band")), "bin").where(f"n < 2 or {inside}").select("f_a", "f_b")  # a row for each bin
        return _fit(kept if kept.count() >= 2 * min_bin else pairs, bins, min_bin)
    finally:
        pairs.unpersist()


def downscale(f: Column, neff: float) -> Column:
    """Counts at the effective size, halves to the even neighbour."""
    return F.rint(f * neff).cast("long")


def test_pair(a: DataFrame, b: DataFrame, *, key: tuple[str, ...] = KEY, neff: float | str | None = "auto", min_total: int = 6, alpha: float = 0.01, **options) -> DataFrame:
    """Counts at the effective size, exact two-sided p, q, and ``dynamics``: emergent, expanded, persistent, contracted, vanishing or untested."""
    size = estimate_neff(a, b, key=key, **options) if neff == "auto" else neff
    pairs = joined(a, b, key)
    if size is not None:
        pairs = pairs.withColumns({f"count_{s}": downscale(F.col(f"f_{s}"), float(size)) for s in "ab"})
    totals = pairs.agg(F.sum("count_a").alias("_ra"), F.sum("count_b").alias("_rb"))  # one row
    pairs = pairs.crossJoin(F.broadcast(totals)).withColumn("_tested", F.col("count_a") + F.col("count_b") >= min_total)
    few = pairs.where("_tested").select("count_a", "count_b", "_ra", "_rb").groupBy("count_a", "count_b", "_ra", "_rb").agg(F.count("*").alias("_k"))
    few = few.withColumn("p_value", fisher_p(F.col("count_a"), F.col("count_b"), F.col("_ra") - F.col("count_a"), F.col("_rb") - F.col("count_b"), "minlike"))
    few = _weighted_bh(few)
    out = pairs.join(few.select("count_a", "count_b", "p_value", "q_value"), ["count_a", "count_b"], "left")
    sig, up = F.col("q_value") < alpha, F.expr("count_b / greatest(_rb, 1) > count_a / greatest(_ra, 1)")
    kind = F.when(~F.col("_tested"), "untested").when(sig & (F.col("count_a") == 0), "emergent").when(sig & (F.col("count_b") == 0), "vanishing").when(sig & up, "expanded").when(sig, "contracted").otherwise("persistent")
    return out.select(*key, "count_a", "count_b", "f_a", "f_b", F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.coalesce("q_value", F.lit(1.0)).alias("q_value"), kind.alias("dynamics"))


def _weighted_bh(few: DataFrame) -> DataFrame:
    """Benjamini-Hochberg over distinct tests (``p_value``) that stand for ``_k`` tests each."""
    per = few.groupBy("p_value").agg(F.sum("_k").alias("_k"))
    up = Window.orderBy("p_value")  # distinct p-values
    per = per.withColumn("_r", F.sum("_k").over(up)).withColumn("_m", F.sum("_k").over(Window.partitionBy()))
    q = F.min(F.col("p_value") * F.col("_m") / F.col("_r")).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return few.join(per.select("p_value", F.least(q, F.lit(1.0)).alias("q_value")), "p_value")


def test_metaclonotypes(a: DataFrame, b: DataFrame, *, scope: str = "1,0,0,1", match_v: bool = True, match_j: bool = True, **options) -> DataFrame:
    """:func:`test_pair` on the components of near junctions over both samples, in place of single clonotypes."""
    calls = [c for c, on in (("v_call", match_v), ("j_call", match_j)) if on]
    both = a.select("junction_aa", *calls).unionByName(b.select("junction_aa", *calls))
    meta = metaclonotypes(both, scope=scope, match_v=match_v, match_j=match_j)
    same = lambda d: d.join(meta, ["junction_aa", *calls]).select("meta", "duplicate_count")
    return test_pair(same(a), same(b), key=("meta",), **options)


def tmm_factor(pairs: DataFrame, *, log_ratio_trim: float = 0.3, sum_trim: float = 0.05) -> float:
    """The trimmed mean of log ratios of two libraries (``count_a, count_b``): what scales the second one's size."""
    totals = pairs.agg(F.sum("count_a").cast("double").alias("_na"), F.sum("count_b").cast("double").alias("_nb"))  # one row
    p = pairs.where("count_a > 0 and count_b > 0").crossJoin(F.broadcast(totals))
    p = p.select(F.expr("log2(count_b / _nb) - log2(count_a / _na)").alias("m"), F.expr("(log2(count_b / _nb) + log2(count_a / _na)) / 2").alias("s"), F.expr("(_nb - count_b) / (_nb * count_b) + (_na - count_a) / (_na * count_a)").alias("v"))
    scratch = Scratch(pairs.sparkSession, "tmm")
    p = scratch.cut(p)
    if p.limit(2).count() < 2:
        scratch.close()
        return 1.0
    ends = [quantiles(scratch, p, c, [t, 1 - t]) for c, t in (("m", log_ratio_trim), ("s", sum_trim))]
    inside = [F.col(c).between(*e) for c, e in zip("ms", ends, strict=True)]
    r = p.where(inside[0] & inside[1]).agg(F.sum(F.col("m") / F.col("v")).alias("x"), F.sum(1 / F.col("v")).alias("w"), F.sum("v").alias("v")).first()
    scratch.close()
    return 2.0 ** (r["x"] / r["w"]) if r["v"] else 1.0


def _log_beta_binomial(y: np.ndarray, t: np.ndarray, r: float) -> np.ndarray:
    """Log chance of ``y`` of ``t`` when the share is Beta(r, r)."""
    lg = np.frompyfunc(math.lgamma, 1, 1)
    f = lambda x: lg(x).astype(float)
    return f(t + 1.0) - f(y + 1.0) - f(t - y + 1.0) + f(y + r) + f(t - y + r) - f(t + 2 * r) + math.lgamma(2 * r) - 2 * math.lgamma(r)


def _beta_binomial(t: int, r: float) -> np.ndarray:
    """The chance of each 0..t when the share is Beta(r, r), by the ratios of neighbours from one end to the middle: its halves are each other's mirror."""
    y = np.arange(t // 2)
    half = np.append(0.0, np.cumsum(np.log((t - y) * (y + r) / ((y + 1) * (t - y - 1 + r)))))
    log_p = np.append(half, half[::-1] if t % 2 else half[-2::-1])
    p = np.exp(log_p - log_p.max())
    return p / p.sum()


def common_dispersion(tables: DataFrame) -> float:
    """The dispersion of ``y`` of ``t`` (equal pairs counted in ``n``) of greatest likelihood, searched by golden section of its logarithm.

    Each step is one aggregation over the distinct pairs.
    """
    tables = tables.where("t > 0").persist()
    try:
        if (tables.agg(F.sum("n")).first()[0] or 0) < 2:
            return 0.1

        def loss(log_phi: float) -> float:
            r = math.exp(-log_phi)

            @F.pandas_udf(T.DoubleType())
            def ll(y: pd.Series, t: pd.Series) -> pd.Series:
                return pd.Series(_log_beta_binomial(y.to_numpy(float), t.to_numpy(float), r))

            return -tables.withColumn("_ll", ll("y", "t")).agg(F.sum(F.col("_ll") * F.col("n"))).first()[0]

        low, high, g = math.log(1e-4), math.log(1e3), (math.sqrt(5) - 1) / 2
        x, y = high - g * (high - low), low + g * (high - low)
        fx, fy = loss(x), loss(y)
        while high - low > 1e-5:
            if fx < fy:
                high, y, fy = y, x, fx
                x = high - g * (high - low)
                fx = loss(x)
            else:
                low, x, fx = x, y, fy
                y = low + g * (high - low)
                fy = loss(y)
        return math.exp((low + high) / 2)
    finally:
        tables.unpersist()


def expansion_test(a: DataFrame, b: DataFrame, *, key: tuple[str, ...] = KEY, dispersion: float | str = "auto", min_total: int = 6, log2fc: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Exact test of two equalised libraries with a common dispersion: ``count_*, q_*, log2fc, p_value, q_value, dispersion, call``."""
    pairs = Scratch(a.sparkSession, "expansion").cut(joined(a, b, key).drop("f_a", "f_b"))  # read often
    f = tmm_factor(pairs)
    totals = pairs.agg(F.sum("count_a").cast("double").alias("_na"), F.sum("count_b").cast("double").alias("_nb"))  # one row
    # Both go to the geometric mean of their effective sizes, the factor split between them.
    scale = {"a": f"sqrt(_nb / _na) * {math.sqrt(f)!r}", "b": f"sqrt(_na / _nb) / {math.sqrt(f)!r}"}
    pairs = pairs.crossJoin(F.broadcast(totals)).withColumns({f"q_{s}": F.expr(f"count_{s} * {x}") for s, x in scale.items()}).drop("_na", "_nb")
    pairs = pairs.withColumns({"y": F.rint("q_a").cast("long"), "t": (F.rint("q_a") + F.rint("q_b")).cast("long")})
    phi = common_dispersion(pairs.groupBy(F.rint("q_a").cast("long").alias("y"), F.rint(F.col("q_a") + F.col("q_b")).cast("long").alias("t")).agg(F.count("*").alias("n"))) if dispersion == "auto" else float(dispersion)
    r = 1.0 / max(phi, 1e-6)

    @F.pandas_udf(T.DoubleType())
    def exact(y: pd.Series, t: pd.Series) -> pd.Series:
        out = np.ones(len(y))
        for n, rows in t.groupby(t).indices.items():
            pmf = _beta_binomial(int(n), r)
            out[rows] = [min(1.0, pmf[pmf <= pmf[i] * (1 + 1e-9)].sum()) for i in y.to_numpy()[rows]]
        return pd.Series(out)

    few = pairs.where(F.col("t") >= min_total).groupBy("y", "t").agg(F.count("*").alias("_k"))
    few = few.repartition(a.sparkSession.sparkContext.defaultParallelism, "y", "t").withColumn("p_value", exact("y", "t"))
    out = pairs.join(_weighted_bh(few).select("y", "t", "p_value", "q_value"), ["y", "t"], "left").withColumn("log2fc", F.log2((F.col("q_b") + 0.5) / (F.col("q_a") + 0.5)))
    sig = (F.col("q_value") < alpha) & (F.abs("log2fc") >= log2fc)
    call = F.when(F.col("p_value").isNull(), "untested").when(sig & (F.col("log2fc") > 0), "expanded").when(sig, "contracted").otherwise("unchanged")
    one = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    return out.select(*key, "count_a", "count_b", "q_a", "q_b", "log2fc", one("p_value"), one("q_value"), F.lit(phi).alias("dispersion"), call.alias("call"))


def _beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # 1 + t1 / (1 + t2 / (1 + ...)), from the innermost of enough terms outward.
    value = 1.0
    for i in range(2 * max(60, int(4 * math.sqrt(max(a, b)))), 0, -1):
        m = i // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + term / value
    return front / value


def student_sf(t: float, df: float) -> float:
    """Two-sided tail of Student's distribution."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def _beta_interval(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [(_beta_quantile(0.025, x, y), _beta_quantile(0.975, x, y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["lo", "hi"])


SIZES = ("singleton", "doubleton", "tripleton", "large")


def capture_rates(pre: DataFrame, post: DataFrame, *, key: tuple[str, ...] = KEY, group: str | None = None, donor: str | None = None) -> DataFrame:
    """How many clonotypes of each size class of ``pre`` are found again in ``post``: ``group, size_class, n_captured, n_total, capture_rate, ci_lo, ci_hi``.

    Rates have a Beta(1, 1) prior. ``group``: a column of ``pre`` (else ``all``); ``donor``: a column of both by which they are paired.
    """
    own = [donor] if donor else []
    sized = pre.groupBy(*own, *key, *([group] if group else [])).agg(F.sum("duplicate_count").alias("_n")).where("_n > 0").withColumn("size_class", size_class(F.col("_n")))
    again = post.where("duplicate_count > 0").select(*own, *key).distinct().withColumn("_met", F.lit(1))
    named = (F.col(group) if group else F.lit("all")).alias("group")
    got = sized.join(again, [*own, *key], "left").groupBy(*own, named, "size_class").agg(F.count("_met").alias("n_captured"), F.count("*").alias("n_total"))
    a, b = F.col("n_captured") + 1.0, F.col("n_total") - F.col("n_captured") + 1.0
    got = got.withColumn("_ci", _beta_interval(a, b)).withColumn("capture_rate", a / (a + b))
    return got.select(*own, "group", "size_class", "n_captured", "n_total", "capture_rate", F.col("_ci.lo").alias("ci_lo"), F.col("_ci.hi").alias("ci_hi"))


def capture_test(rates: DataFrame, *, group: str = "group", div_ratio: dict[str, float] | None = None, donor: str = "donor") -> DataFrame:
    """Least squares of the log rate on size class and group (and a donor's log diversity ratio): ``term, estimate, std_error, p_value``.

    One group sees all rates: there is one for each donor, group and size class.
    """
    ratio = {k: math.log(v) for k, v in (div_ratio or {}).items()}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["capture_rate"] > 0]
        sizes = [s for s in SIZES if (rows["size_class"] == s).any()][1:]
        groups = sorted(rows[group].unique())[1:]
        columns = {"intercept": np.ones(len(rows))}
        columns |= {f"size:{s}": (rows["size_class"] == s).to_numpy(float) for s in sizes} | {f"group:{g}": (rows[group] == g).to_numpy(float) for g in groups}
        if ratio:
            columns["log_div_ratio"] = rows[donor].map(ratio).to_numpy(float)
        x, y = np.column_stack(list(columns.values())), np.log(rows["capture_rate"].to_numpy(float))
        inverse = np.linalg.pinv(x.T @ x)
        estimate = inverse @ x.T @ y
        free = len(y) - x.shape[1]
        off = y - x @ estimate
        error = np.sqrt(np.clip(np.diag(inverse) * (off @ off) / free, 0, None)) if free > 0 else np.full(len(columns), np.nan)
        p = [student_sf(e / s, free) if s > 0 else float("nan") for e, s in zip(estimate, error, strict=True)]
        return pd.DataFrame({"term": list(columns), "estimate": estimate, "std_error": error, "p_value": p})

    return rates.groupBy().applyInPandas(run, "term string, estimate double, std_error double, p_value double")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if x != x or n != n else student_sf(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")


def capture_paired_test(rates: DataFrame, *, group: str = "group", donor: str = "donor") -> DataFrame:
    """Paired t-test of log rates of two groups over donors, by size class: ``size_class, n_pairs, t, p_value``; null with fewer than two pairs."""
    levels = sorted(r[0] for r in rates.select(group).distinct().limit(3).collect())
    if len(levels) != 2:
        raise ValueError(f"a paired test needs two levels of {group}, not {levels}")
    side = lambda g: F.max(F.when(F.col(group) == g, F.log("capture_rate")))
    pairs = rates.groupBy("size_class", donor).agg((side(levels[0]) - side(levels[1])).alias("off"))
    out = pairs.groupBy("size_class").agg(F.count("off").alias("n_pairs"), F.avg("off").alias("m"), F.stddev_samp("off").alias("s"))
    t = F.when(F.col("n_pairs") >= 2, F.try_divide(F.col("m"), F.col("s") / F.sqrt("n_pairs")))
    return out.select("size_class", "n_pairs", t.alias("t"), student_p(t, F.col("n_pairs") - 1.0).alias("p_value"))
