"""Association of clonotypes with phenotypes: designs, candidates, exact and stratified tests, and false discovery rates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.clonotype import SAMPLE, strip_allele, to_bool
from .neighbours import near_pairs
from .pairs import TILE, pairs_between

KEY = ("junction_aa", "v_call", "j_call")


def binary(meta: DataFrame, column: str, *, sample: str = SAMPLE) -> DataFrame:
    """``sample_id, level, positive`` for samples whose value reads as yes or no."""
    return meta.select(sample, F.lit(column).alias("level"), to_bool(F.col(column)).alias("positive")).dropna().dropDuplicates([sample])


def categorical(meta: DataFrame, column: str, *, min_level_size: int = 1, sample: str = SAMPLE) -> DataFrame:
    """Each level against the rest: every sample with a value meets every level (levels are few)."""
    known = meta.select(sample, F.col(column).cast("string").alias("own")).dropna().dropDuplicates([sample])
    levels = known.groupBy(F.col("own").alias("level")).agg(F.count("*").alias("n")).where(F.col("n") >= min_level_size).select("level")
    return known.crossJoin(levels).select(sample, "level", (F.col("own") == F.col("level")).alias("positive"))


def hla_alleles(meta: DataFrame, columns: list[str], *, resolution: int | None = None, min_level_size: int = 1, sample: str = SAMPLE) -> DataFrame:
    """Carriage of each allele, over samples that are typed; ``resolution`` keeps that many fields."""
    typed = meta.select(sample, F.explode(F.array(*columns)).alias("allele")).where("allele is not null")
    if resolution:
        typed = typed.withColumn("allele", F.array_join(F.slice(F.split("allele", ":"), 1, resolution), ":"))
    typed = typed.distinct()
    levels = typed.groupBy(F.col("allele").alias("level")).agg(F.count("*").alias("n")).where(F.col("n") >= min_level_size).select("level")
    grid = typed.select(sample).distinct().crossJoin(levels)
    held = typed.select(sample, F.col("allele").alias("level"), F.lit(True).alias("positive"))
    return grid.join(held, [sample, "level"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


def zygosity(meta: DataFrame, first: str, second: str, *, sample: str = SAMPLE) -> DataFrame:
    """Whether both alleles of a locus are the same; samples with a missing allele are left out."""
    return meta.select(sample, F.lit("homozygous").alias("level"), (F.col(first) == F.col(second)).alias("positive")).dropna().dropDuplicates([sample])


def features(df: DataFrame, key: tuple[str, ...] = KEY, *, productive: bool = True, strip: bool = True, sample: str = SAMPLE) -> DataFrame:
    """Distinct sample and key: incidence. Unproductive junctions are left out and calls lose their alleles."""
    if productive:
        df = df.where(~F.col("junction_aa").rlike("[*_]"))
    columns = [strip_allele(F.col(c)).alias(c) if strip and c.endswith("_call") else F.col(c) for c in key]
    return df.select(sample, *columns).dropna(subset=list(key)).distinct()


def select_candidates(df: DataFrame, key: tuple[str, ...] = KEY, *, min_incidence: int = 2, min_share: float | None = None, sample: str = SAMPLE, **options) -> DataFrame:
    """Keys of enough distinct samples, with their ``incidence``."""
    x = features(df, key, sample=sample, **options)
    out = x.groupBy(*key).agg(F.count("*").alias("incidence"))
    if min_share is None:
        return out.where(F.col("incidence") >= min_incidence)
    n = x.agg(F.ceil(F.countDistinct(sample) * min_share).alias("_n"))  # one row
    return out.crossJoin(n).where(F.col("incidence") >= F.greatest(F.lit(min_incidence), F.col("_n"))).drop("_n")


def _log_pmf(a: np.ndarray, n: int, pos: int, present: int, table: np.ndarray) -> np.ndarray:
    lf = lambda k: table[k]
    return lf(pos) - lf(a) - lf(pos - a) + lf(n - pos) - lf(present - a) - lf(n - pos - present + a) - lf(n) + lf(present) + lf(n - present)


def fisher_p(a: Column, b: Column, c: Column, d: Column, alternative: str = "greater") -> Column:
    """Exact p of 2 x 2 tables: tails of the hypergeometric distribution; ``two-sided`` doubles the smaller one, ``minlike`` sums what is no likelier."""

    @pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        t = pd.DataFrame({"a": a, "b": b, "c": c, "d": d}).astype("int64")
        table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(t.sum(axis=1).max()) + 1)))]) if len(t) else np.zeros(1)
        out = np.ones(len(t))
        margins = pd.DataFrame({"n": t.sum(axis=1), "pos": t.a + t.c, "present": t.a + t.b})
        for (n, pos, present), rows in margins.groupby(["n", "pos", "present"]).indices.items():  # tables of one support share its tails
            low, high = max(0, present + pos - n), min(pos, present)
            pmf = np.exp(_log_pmf(np.arange(low, high + 1), n, pos, present, table))
            upper, lower = np.cumsum(pmf[::-1])[::-1], np.cumsum(pmf)
            at = t.a.to_numpy()[rows] - low
            if alternative == "greater":
                p = upper[at]
            elif alternative == "less":
                p = lower[at]
            elif alternative == "two-sided":
                p = 2 * np.minimum(upper[at], lower[at])
            else:
                p = np.array([pmf[pmf <= pmf[i] * (1 + 1e-7)].sum() for i in at])
            out[rows] = np.minimum(p, 1.0)
        return pd.Series(out)

    return run(a, b, c, d)


@pandas_udf(T.DoubleType())
def chi2_sf1(stat: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return stat.map(lambda x: math.erfc(math.sqrt(x / 2)))


def chi2_stat(a: Column, b: Column, c: Column, d: Column, yates: bool = True) -> Column:
    """Pearson's statistic, with Yates' correction; 0 where a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    off = F.greatest(F.abs(a * d - b * c) - (n / 2 if yates else 0), F.lit(0.0))
    return F.coalesce(F.try_divide(n * off * off, (a + b) * (c + d) * (a + c) * (b + d)), F.lit(0.0))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def direction(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when(a * (b + d) > b * (a + c), "enriched").otherwise("depleted")


def fdr_bh(df: DataFrame, p: str = "p_value", out: str = "q_value", by: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg within ``by``.

    Ranks are counted on distinct p-values: tests of one design share a few margins, so their p-values are few
    and the windows run over that small table, not over the tests.
    """
    few = df.groupBy(*by, p).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*by).orderBy(p)
    few = few.withColumn("_r", F.sum("_n").over(up)).withColumn("_m", F.sum("_n").over(Window.partitionBy(*by)))
    q = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(Window.partitionBy(*by).orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.join(few.select(*by, p, F.least(q, F.lit(1.0)).alias(out)), [*by, p])


def contingency(df: DataFrame, design: DataFrame, key: tuple[str, ...] = KEY, *, stratum: str | None = None, sample: str = SAMPLE, **options) -> DataFrame:
    """Tables ``a, b, c, d`` by key and level (and stratum): present and positive, present and negative, absent likewise."""
    by = ["level", *([stratum] if stratum else [])]
    met = features(df, key, sample=sample, **options).join(design, sample)
    met = met.groupBy(*key, *by).agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    sizes = design.groupBy(*by).agg(F.count_if("positive").alias("_p"), F.count_if(~F.col("positive")).alias("_q"))
    return met.join(sizes, by).select(*key, *by, "a", "b", (F.col("_p") - F.col("a")).alias("c"), (F.col("_q") - F.col("b")).alias("d"))


def association(df: DataFrame, design: DataFrame, key: tuple[str, ...] = KEY, *, min_incidence: int = 2, alternative: str = "greater", test: str = "fisher", sample: str = SAMPLE, **options) -> DataFrame:
    """Tests of every candidate at every level, with odds ratio, direction, p and q."""
    t = contingency(df, design, key, sample=sample, **options).where(F.col("a") + F.col("b") >= min_incidence)
    cells = [F.col(c) for c in "abcd"]
    # Few distinct tables: the test runs on them alone.
    tables = t.select(*"abcd").distinct()
    p = fisher_p(*cells, alternative) if test == "fisher" else chi2_sf1(chi2_stat(*cells))
    tested = t.join(tables.withColumn("p_value", p), list("abcd"))
    tested = tested.withColumn("odds_ratio", odds_ratio(*cells)).withColumn("direction", direction(*cells))
    return fdr_bh(tested, by=("level",))


def cmh(tables: DataFrame, by: list[str]) -> DataFrame:
    """Mantel-Haenszel odds ratio and corrected chi-square over the strata of ``tables``; strata of fewer than two add nothing."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    ok = tables.withColumn("_n", n).where("_n >= 2")
    sums = ok.groupBy(*by).agg(
        F.sum(a * d / n).alias("_up"), F.sum(b * c / n).alias("_down"), F.sum(a).alias("_obs"), F.sum((a + b) * (a + c) / n).alias("_exp"),
        F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("_var"),
    )
    ratio = F.when(F.col("_down") > 0, F.try_divide("_up", "_down")).when(F.col("_up") > 0, float("inf")).otherwise(float("nan"))
    off = F.greatest(F.abs(F.col("_obs") - F.col("_exp")) - 0.5, F.lit(0.0))
    out = sums.select(*by, ratio.alias("or_mh"), F.when(F.col("_var") > 0, F.try_divide(off * off, F.col("_var"))).otherwise(0.0).alias("chi2"))
    return out.withColumn("p_value", chi2_sf1("chi2"))


def stratified(meta: DataFrame, phenotype: str, stratum: str, *, sample: str = SAMPLE) -> DataFrame:
    """A binary design with the stratum of each sample."""
    return binary(meta, phenotype, sample=sample).join(meta.select(sample, F.col(stratum).alias("stratum")).dropna().dropDuplicates([sample]), sample)


def chi2_p(a: Column, b: Column, c: Column, d: Column, yates: bool = True) -> Column:
    return chi2_sf1(chi2_stat(a, b, c, d, yates))


@pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))


def bayes_logodds(a: Column, b: Column, c: Column, d: Column, alpha: float = 0.5) -> dict[str, Column]:
    """Normal posterior of the log odds ratio: mean, deviation, 95 percent interval, chance of a ratio above one."""
    cells = [x.cast("double") + alpha for x in (a, b, c, d)]
    mean = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    se = F.sqrt(sum((1 / x for x in cells), F.lit(0.0)))
    z = 1.959963984540054  # two-sided 95 percent
    return {"logor": mean, "se": se, "ci_lo": mean - z * se, "ci_hi": mean + z * se, "p_or_gt1": normal_cdf(mean / se)}


def bayes_bf(a: Column, b: Column, c: Column, d: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Log Bayes factor of two rates against one, with Beta priors."""

    @pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        log_beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
        none = log_beta(alpha, beta)
        return pd.Series([log_beta(p + alpha, r + beta) + log_beta(q + alpha, s + beta) - none - log_beta(p + q + alpha, r + s + beta) for p, q, r, s in zip(a, b, c, d, strict=True)], dtype="float64")

    return run(a, b, c, d)


#: Samples of a feature whose permuted labels are added up in one row; features of more are added up in parts.
TOGETHER = 256


def permuted_labels(design: DataFrame, n_perm: int, seed: int = 0, sample: str = SAMPLE) -> DataFrame:
    """``sample, level, positive, labels``: each sample's labels in all permutations as bits, eight to a byte, the first highest.

    Permutation i of a level marks as many samples as are positive, those of least md5 of ``<seed>:<i>:<level>:<sample>``.
    """
    draws = design.select(sample, "level", "positive", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("_i"))
    order = Window.partitionBy("level", "_i").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "_i", "level", sample)), sample)
    marked = F.row_number().over(order) <= F.count_if("positive").over(Window.partitionBy("level", "_i"))
    eighth = draws.withColumn("_x", F.when(marked, F.expr("shiftleft(1, 7 - _i % 8)")).otherwise(0)).groupBy(sample, "level", "positive", F.expr("_i div 8").alias("_at")).agg(F.sum("_x").cast("int").alias("_x"))
    bytes_ = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_x"))), lambda x: F.lpad(F.hex(x["_x"]), 2, "0"))
    return eighth.groupBy(sample, "level", "positive").agg(F.unhex(F.concat_ws("", bytes_)).alias("labels"))


def _added_labels(n_perm: int):
    """``a`` and ``counts``: the positive samples among those of a row, and by permutation how many are marked (32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c not in ("labels", "of")]
            counts = [np.unpackbits(np.frombuffer(b"".join(x.as_py()), np.uint8).reshape(len(x), -1), axis=1, count=n_perm).sum(axis=0, dtype=np.uint32).tobytes() for x in batch.column("labels")]
            a = [sum(x.as_py()) for x in batch.column("of")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(a, pa.int64()), pa.array(counts, pa.binary())], [*kept, "a", "counts"])

    return run


def _as_extreme(greater: bool):
    """``a`` and ``hits`` of features whose parts ``of`` and ``counts`` are lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, got = [c for c in batch.schema.names if c not in ("counts", "of")], []
            for of, counts in zip(batch.column("of"), batch.column("counts"), strict=True):
                a, total = sum(of.as_py()), np.frombuffer(b"".join(counts.as_py()), np.uint32).reshape(len(counts), -1).sum(axis=0, dtype=np.int64)
                got.append((a, int((total >= a).sum() if greater else (total <= a).sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([x[i] for x in got], pa.int64()) for i in (0, 1))], [*kept, "a", "hits"])

    return run


def permutation_p(incidence: DataFrame, design: DataFrame, key: tuple[str, ...] = KEY, *, n_perm: int = 1000, seed: int = 0, alternative: str = "greater", sample: str = SAMPLE) -> DataFrame:
    """``key, level, a, p_value``: how often permuted labels give a feature at least (at most) its positive samples, add-one.

    A sample's labels in all permutations are bits of one binary (:func:`permuted_labels`), so what is shuffled and counted is one row for each
    incidence, whatever ``n_perm``. A feature of more than ``TOGETHER`` samples is added up in parts of about so many. A feature and
    level without any labelled sample has no row; samples without labels, and null keys, don't count.
    """
    if alternative not in ("greater", "less"):
        raise ValueError("alternative must be greater or less")
    held = incidence.select(sample, *key).distinct()
    sizes = held.groupBy(*key).agg(F.ceil(F.count("*") / TOGETHER).alias("_parts"))
    held = held.join(sizes, list(key)).withColumn("_part", F.pmod(F.xxhash64(sample), F.col("_parts"))).join(permuted_labels(design, n_perm, seed, sample), sample)
    types = {**dict(held.dtypes), "a": "bigint", "hits": "bigint", "counts": "binary"}
    schema = lambda *columns: ", ".join(f"`{c}` {types[c]}" for c in columns)
    parts = held.groupBy(*key, "level", "_parts", "_part").agg(F.collect_list("labels").alias("labels"), F.collect_list("positive").alias("of"))
    added = parts.mapInArrow(_added_labels(n_perm), schema(*key, "level", "_parts", "_part", "a", "counts"))
    one = added.where("_parts = 1").select(*key, "level", F.array("a").alias("of"), F.array("counts").alias("counts"))
    many = added.where("_parts > 1").groupBy(*key, "level").agg(F.collect_list("a").alias("of"), F.collect_list("counts").alias("counts"))
    hits = [x.mapInArrow(_as_extreme(alternative == "greater"), schema(*key, "level", "a", "hits")) for x in (one, many)]
    counted = hits[0].unionByName(hits[1])
    return counted.select(*key, "level", "a", ((1.0 + F.col("hits")) / (1.0 + n_perm)).alias("p_value"))


def fuzzy_features(df: DataFrame, key: tuple[str, ...] = KEY, *, candidates: DataFrame | None = None, scope: str = "1,0,0,1", sample: str = SAMPLE, **options) -> DataFrame:
    """Incidence of candidate keys (by default all) in the samples that hold one of their neighbours: junction within ``scope``, the other columns equal."""
    if "junction_aa" not in key:
        raise ValueError("fuzzy features need junction_aa in the key")
    held = features(df, key, sample=sample, **options)
    rest = [c for c in key if c != "junction_aa"]
    wanted = held.select(*key).distinct() if candidates is None else candidates.select(*key).distinct()
    pairs = near_pairs(wanted, held, keys=rest, scope=scope)
    near = held.withColumnRenamed("junction_aa", "seq_b").join(pairs, [*rest, "seq_b"])
    return near.select(sample, F.col("seq_a").alias("junction_aa"), *rest).distinct().select(sample, *key)


def cooccurrence(
    df: DataFrame, *, chain_a: str = "TRA", chain_b: str = "TRB", key: tuple[str, ...] = KEY, min_incidence: int = 2, min_cooccurrence: int = 2, test: str = "fisher", alternative: str = "greater",
    depth_strata: int = 0, min_stratum: int = 20, sample: str = SAMPLE, tile: int = TILE, **options,
) -> DataFrame:
    """Pairs of features of two chains that stand in one sample together: ``n, n_a, n_b, n_ab, theta, odds_ratio, log2_or, p_value, q_value``.

    Samples that hold both chains are counted. Pairs meet by sample, block by block in samples of very many features, and no feature is
    left out for being many. ``depth_strata``: with more than 1, samples are cut into as many strata of equal numbers by
    how many features they hold (at least ``min_stratum`` samples each) and p is that of the stratified test; else the pooled test.
    """
    named = lambda chain, x: features(df.where(F.substring("v_call", 1, 3) == chain), key, sample=sample, **options).select(sample, F.struct(*key).alias(x))
    a, b = named(chain_a, "a"), named(chain_b, "b")
    both = a.select(sample).distinct().join(b.select(sample).distinct(), sample)
    common = lambda x, c: x.join(x.groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_incidence).select(c), c).join(both, sample)
    depth = a.unionByName(b.withColumnRenamed("b", "a")) if chain_a != chain_b else a
    depth = depth.join(both, sample).groupBy(sample).agg(F.count("*").alias("_depth"))
    sizes = depth.agg(F.count("*").alias("n"), (F.stddev_samp("_depth") / F.avg("_depth")).alias("_cv"))  # one row
    k = F.when((F.coalesce("_cv", F.lit(0.0)) >= 0.45) & (F.col("n") >= 2 * min_stratum), F.least(F.lit(depth_strata), F.floor(F.col("n") / min_stratum))).otherwise(1)
    place = depth.withColumn("_at", F.percent_rank().over(Window.orderBy("_depth"))) if depth_strata > 1 else depth.withColumn("_at", F.lit(0.0))  # one row for each sample
    place = place.crossJoin(sizes).select(sample, "n", F.ceil(F.col("_depth") / tile).cast("int").alias("_blocks"), F.least(F.floor(F.col("_at") * k), k - 1).alias("stratum"))
    left, right = common(a, "a").join(place, sample), common(b, "b").join(place.drop("n"), sample)
    met = pairs_between(left, right.drop("stratum"), [sample], "a", "b")
    if chain_a == chain_b:
        met = met.where("a < b")
    cells = met.groupBy("a", "b", "stratum", "n").agg(F.count("*").alias("ab"))
    ok = cells.groupBy("a", "b").agg(F.sum("ab").alias("n_ab")).where(F.col("n_ab") >= min_cooccurrence)
    of_a, of_b = left.groupBy("a", "stratum").agg(F.count("*").alias("sa")), right.groupBy("b", "stratum").agg(F.count("*").alias("sb"))
    out = ok.join(of_a.groupBy("a").agg(F.sum("sa").alias("n_a")), "a").join(of_b.groupBy("b").agg(F.sum("sb").alias("n_b")), "b").crossJoin(sizes.select("n"))
    ab, na, nb, n = (F.col(c) for c in ("n_ab", "n_a", "n_b", "n"))
    cell = [ab, na - ab, nb - ab, n - na - nb + ab]
    out = out.withColumns({"theta": n * ab / (na * nb), "odds_ratio": odds_ratio(*cell), "log2_or": F.log2(odds_ratio(*cell))})
    if depth_strata > 1:
        of = place.groupBy("stratum").agg(F.count("*").alias("sn"))
        full = ok.select("a", "b").crossJoin(F.broadcast(of)).join(of_a, ["a", "stratum"], "left").join(of_b, ["b", "stratum"], "left").join(cells.select("a", "b", "stratum", "ab"), ["a", "b", "stratum"], "left").fillna(0, ["sa", "sb", "ab"])
        tables = full.select(F.struct("a", "b").alias("pair"), F.col("ab").alias("a"), (F.col("sa") - F.col("ab")).alias("b"), (F.col("sb") - F.col("ab")).alias("c"), (F.col("sn") - F.col("sa") - F.col("sb") + F.col("ab")).alias("d"))
        mh = cmh(tables, ["pair"]).select("pair.*", "or_mh", "chi2", "p_value")
        half = F.col("p_value") / 2
        above = F.col("or_mh") > 1
        one = {"greater": F.when(above, half).otherwise(1 - half), "less": F.when(above, 1 - half).otherwise(half)}.get(alternative, F.col("p_value"))
        out = out.join(mh.withColumn("p_value", one), ["a", "b"])
    else:
        out = out.withColumn("p_value", fisher_p(*cell, alternative) if test == "fisher" else chi2_p(*cell))
    out = fdr_bh(out)
    named = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in key]
    return out.select(*named, *(c for c in out.columns if c not in ("a", "b")))
