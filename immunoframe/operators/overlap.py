"""Overlap of samples: shared clonotypes, all pairs of a cohort in one pass, and near matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clonotype import RESIDUES, SAMPLE, ratio_within
from .neighbours import near_pairs
from .pairs import TILE, pairs_within

KEY = ("junction_aa", "v_call", "j_call")


def aggregate(df: DataFrame, key: tuple[str, ...] = KEY, *, standard_aa: bool = False, sample: str = SAMPLE) -> DataFrame:
    """Counts by sample and key, and their share of the sample; with ``standard_aa`` only of junctions of plain residues."""
    if standard_aa:
        df = df.where(F.col("junction_aa").rlike(f"^[{RESIDUES}]+$"))
    out = df.groupBy(sample, *key).agg(F.sum("duplicate_count").alias("count"))
    return out.withColumn("freq", ratio_within(F.col("count"), (sample,)))


def overlap_pair(a: DataFrame, b: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The clonotypes that two samples share, with counts and frequencies in both."""
    x, y = (aggregate(d, key).select(*key, F.col("count").alias(f"count_{s}"), F.col("freq").alias(f"freq_{s}")) for d, s in ((a, "a"), (b, "b")))
    return x.join(y, list(key))


def _pearson(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """From sums; null for a side that doesn't vary."""
    return F.try_divide(n * ab - a * b, F.sqrt(F.greatest(n * aa - a * a, F.lit(0.0))) * F.sqrt(F.greatest(n * bb - b * b, F.lit(0.0))))


def cohort_overlap(df: DataFrame, key: tuple[str, ...] = KEY, *, sample: str = SAMPLE, tile: int = TILE) -> DataFrame:
    """``sample_a < sample_b`` with sizes, shared clonotypes and D, F, F2, R and Jaccard; pairs that share nothing have no row.

    Samples meet by key, block by block where very many samples share one, and sums are combined before the second shuffle. Keys of one
    sample leave before the join.
    """
    per = aggregate(df, key, sample=sample)
    sizes = per.groupBy(sample).agg(F.count("*").alias("n"))
    held = per.dropna(subset=list(key)).select(*key, F.col(sample).alias("sample"), F.col("freq").alias("f"))
    fa, fb, ab = F.col("f_a"), F.col("f_b"), F.col("f_a") * F.col("f_b")
    met = pairs_within(held, list(key), "sample", ["f"], tile).groupBy("sample_a", "sample_b").agg(
        F.count("*").alias("shared"), F.sum(ab).alias("_ab"), F.sum(F.sqrt(ab)).alias("_root"), F.sum(fa).alias("_a"), F.sum(fb).alias("_b"),
        F.sum(fa * fa).alias("_aa"), F.sum(fb * fb).alias("_bb"),
    )
    for s in "ab":
        met = met.join(sizes.select(F.col(sample).alias(f"sample_{s}"), F.col("n").alias(f"n_{s}")), f"sample_{s}")
    n = F.col("shared").cast("double")
    r = F.when(F.col("shared") > 2, _pearson(n, *(F.col(c) for c in ("_a", "_b", "_aa", "_bb", "_ab"))))
    return met.select(
        "sample_a", "sample_b", "n_a", "n_b", "shared", (n / (F.col("n_a") * F.col("n_b"))).alias("D"), F.sqrt("_ab").alias("F"), F.col("_root").alias("F2"), r.alias("R"),
        (n / (F.col("n_a") + F.col("n_b") - n)).alias("jaccard"),
    )


def overlap_metrics(a: DataFrame, b: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The metrics of two samples, one row; none if they share nothing."""
    return cohort_overlap(a.select(F.lit("a").alias(SAMPLE), *key, "duplicate_count").unionByName(b.select(F.lit("b").alias(SAMPLE), *key, "duplicate_count")), key)


def cohort_fuzzy_overlap(df: DataFrame, scope: str = "1,0,0,1", *, sample: str = SAMPLE) -> DataFrame:
    """``sample_a, sample_b, freq_a, freq_b, fuzzy_F`` of all ordered pairs of samples with near junctions: the share of a sample's reads that have a neighbour in the other.

    Neighbours are found once among all junctions of the cohort; a junction counts once for a sample, however many neighbours it has there.
    """
    held = df.where("junction_aa is not null").groupBy(F.col(sample).alias("sample"), F.col("junction_aa").alias("seq")).agg(F.sum("duplicate_count").alias("_n"))
    held = held.join(df.groupBy(F.col(sample).alias("sample")).agg(F.sum("duplicate_count").alias("_of")), "sample").select("sample", "seq", (F.col("_n") / F.col("_of")).alias("f"))
    words = df.select("junction_aa").dropna().distinct()
    links = near_pairs(words, words, scope=scope).select("seq_a", "seq_b")
    both = []
    for near, far in ("ab", "ba"):
        there = held.select(F.col("seq").alias(f"seq_{far}"), F.col("sample").alias(f"sample_{far}"))
        reached = links.join(there, f"seq_{far}").select(f"seq_{near}", f"sample_{far}").distinct()
        mine = held.select(F.col("sample").alias(f"sample_{near}"), F.col("seq").alias(f"seq_{near}"), "f")
        both.append(mine.join(reached, f"seq_{near}").where("sample_a <> sample_b").groupBy("sample_a", "sample_b").agg(F.sum("f").alias(f"freq_{near}")))
    return both[0].join(both[1], ["sample_a", "sample_b"]).withColumn("fuzzy_F", F.sqrt(F.col("freq_a") * F.col("freq_b")))


def pairwise_distances(df: DataFrame, metric: str = "F", key: tuple[str, ...] = KEY, *, scope: str | None = None, form: str = "long", sample: str = SAMPLE) -> DataFrame:
    """``sample_a, sample_b, distance`` for all ordered pairs of samples; 0 on the diagonal, similarity 0 where nothing is shared.

    ``scope``: distances of the fuzzy F within this edit scope (metric ``F`` only; ``key`` is not used). ``form="matrix"``: ``sample``
    and a column for each sample, which asks for their names, so it is for as many samples as a table can have columns.
    """
    if form not in ("long", "matrix") or metric not in ("F", "F2", "D", "R", "jaccard") or (scope and metric != "F"):
        raise ValueError("form is long or matrix, the metric F, F2, D, R or jaccard, and F with a scope")
    distance = {"R": lambda x: (1 - x) / 2, "jaccard": lambda x: 1 - x}.get(metric, lambda x: -F.log10(x + 1e-9))
    names = df.select(sample).distinct()
    grid = names.select(F.col(sample).alias("sample_a")).crossJoin(names.select(F.col(sample).alias("sample_b")))  # the result has this many rows
    if scope:
        got = cohort_fuzzy_overlap(df, scope, sample=sample).where("sample_a < sample_b").select("sample_a", "sample_b", F.col("fuzzy_F").alias("x"))
    else:
        got = cohort_overlap(df, key, sample=sample).select("sample_a", "sample_b", F.col(metric).alias("x"))
    both = got.unionByName(got.select(F.col("sample_b").alias("sample_a"), F.col("sample_a").alias("sample_b"), "x"))
    joined = grid.join(both, ["sample_a", "sample_b"], "left")
    out = joined.select("sample_a", "sample_b", F.when(F.col("sample_a") == F.col("sample_b"), 0.0).otherwise(distance(F.coalesce("x", F.lit(0.0)))).alias("distance"))
    if form == "long":
        return out
    columns = sorted(r[0] for r in names.collect())  # the columns of the result
    return out.groupBy(F.col("sample_a").alias("sample")).pivot("sample_b", columns).agg(F.first("distance"))


def fuzzy_overlap(a: DataFrame, b: DataFrame, scope: str = "1,0,0,1") -> DataFrame:
    """Pairs of junctions of two samples within the edit scope, with the summed frequencies of both."""
    sides = [d.groupBy(F.col("junction_aa").alias(f"seq_{s}")).agg(F.sum("frequency").alias(f"freq_{s}")) for d, s in ((a, "a"), (b, "b"))]
    return near_pairs(a, b, scope=scope).join(sides[0], "seq_a").join(sides[1], "seq_b").select("seq_a", "seq_b", "distance", "freq_a", "freq_b")


def fuzzy_overlap_metrics(a: DataFrame, b: DataFrame, scope: str = "1,0,0,1") -> DataFrame:
    """Pairs, matched shares of clonotypes and of frequency of both samples, and the joint F; each junction counts once."""
    pairs = fuzzy_overlap(a, b, scope)
    one = pairs.agg(F.count("*").alias("pairs"))
    for s, d in (("a", a), ("b", b)):
        matched = pairs.select(f"seq_{s}", f"freq_{s}").distinct().agg(F.count("*").alias("_n"), F.coalesce(F.sum(f"freq_{s}"), F.lit(0.0)).alias(f"freq_{s}"))
        size = d.where("junction_aa is not null").agg(F.countDistinct("junction_aa").alias("_of"))
        one = one.crossJoin(matched.crossJoin(size).select(F.try_divide("_n", "_of").alias(f"matched_{s}"), f"freq_{s}"))  # single rows
    return one.withColumn("fuzzy_F", F.sqrt(F.col("freq_a") * F.col("freq_b")))
