"""Chains of single cells: resolution, pairing, and how many chains cells have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

HEAVY, LIGHT = ("TRB", "TRD", "IGH"), ("TRA", "TRG", "IGK", "IGL")


def resolve_chains(contigs: DataFrame, *, ratio: float = 0.1, min_umi: int = 2, min_reads: int = 5) -> DataFrame:
    """One heavy and one light chain of each cell, and a second light one that is strong enough beside the first.

    Roles are per receptor family pooled over loci (kappa and lambda jointly); nulls rank last, ties by ``ord``.
    """
    role = F.when(F.col("locus").isin(*HEAVY), "heavy").when(F.col("locus").isin(*LIGHT), "light")
    w = Window.partitionBy("cell_id", "_role").orderBy(F.desc_nulls_last("duplicate_count"), F.desc_nulls_last("umi_count"), "ord")
    x = contigs.withColumn("_role", role).where("_role is not null").withColumn("_r", F.row_number().over(w))
    own = Window.partitionBy("cell_id", "_role")
    for c in ("duplicate_count", "umi_count"):
        x = x.withColumn(f"_{c}", F.max(F.when(F.col("_r") == 1, F.col(c))).over(own))
    strong = (
        (F.try_divide("duplicate_count", "_duplicate_count") > ratio) & (F.try_divide("umi_count", "_umi_count") > ratio)
        & (F.col("umi_count") >= min_umi) & (F.col("duplicate_count") >= min_reads)
    )
    kept = (F.col("_r") == 1) | (F.col("_role") == "light") & (F.col("_r") == 2) & F.coalesce(strong, F.lit(False))
    return x.where(kept).select(*contigs.columns)


def _family(contigs: DataFrame, pair: str, resolve: bool) -> list[DataFrame]:
    light, heavy = pair.split("_") if not pair.startswith("IGH") else pair.split("_")[::-1]
    x = resolve_chains(contigs) if resolve else contigs
    return [x.where(F.col("locus") == light), x.where(F.col("locus") == heavy)]


def pair_chains(contigs: DataFrame, pair: str = "TRA_TRB", resolve: bool = True) -> DataFrame:
    """Each light with each heavy chain of a cell; cells with several pairs get numbered ``pair_id``."""
    columns = ("v_call", "j_call", "junction_aa", "umi_count", "duplicate_count", "ord")
    light, heavy = (d.select("cell_id", *(F.col(c).alias(f"{s}_{c}") for c in columns)) for d, s in zip(_family(contigs, pair, resolve), ("alpha", "beta"), strict=True))
    both = light.join(heavy, "cell_id")
    w = Window.partitionBy("cell_id")
    nth = F.row_number().over(w.orderBy("beta_ord", "alpha_ord"))
    both = both.withColumn("_n", F.count("*").over(w)).withColumn("_i", nth)
    name = F.when(F.col("_n") == 1, F.col("cell_id")).otherwise(F.concat_ws("_", "cell_id", F.col("_i").cast("string")))
    return both.withColumn("pair_id", name).drop("_n", "_i", "alpha_ord", "beta_ord")


def chain_multiplicity(contigs: DataFrame, pair: str = "TRA_TRB") -> DataFrame:
    """How many cells have each number of light and heavy chains of a family."""
    light, heavy = _family(contigs, pair, False)
    marked = light.select("cell_id", F.lit(1).alias("l"), F.lit(0).alias("h")).unionByName(heavy.select("cell_id", F.lit(0).alias("l"), F.lit(1).alias("h")))
    cells = marked.groupBy("cell_id").agg(F.sum("l").alias("n_light"), F.sum("h").alias("n_heavy"))
    return cells.groupBy("n_light", "n_heavy").agg(F.count("*").alias("cells"))


def flag_mispairing(paired: DataFrame, *, max_slaves_per_master: int | None = None, drop: bool = False) -> DataFrame:
    """``mispairing_flag`` and ``mispairing_reason`` of paired chains: ``ok``, ``noncanonical_alpha`` or ``ambient_master``.

    The canonical light chain of a heavy one is that of most cells (then of most support, then the first). Another one is
    flagged, unless its cell holds the canonical one too. ``max_slaves_per_master``: a heavy chain with more light ones is ambient.
    """
    if max_slaves_per_master is not None and max_slaves_per_master <= 0:
        raise ValueError("max_slaves_per_master must be positive")
    key = lambda x: F.concat(f"{x}_v_call", F.lit("|"), f"{x}_j_call", F.lit("|"), f"{x}_junction_aa")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    work = paired.withColumns({"_m": key("beta"), "_s": key("alpha"), "_w": count("alpha_duplicate_count") + count("alpha_umi_count")})
    edges = work.groupBy("_m", "_s").agg(F.count("*").alias("_n"), F.sum("_w").alias("_w"))
    best = F.row_number().over(Window.partitionBy("_m").orderBy(F.desc("_n"), F.desc("_w"), "_s"))
    of = edges.withColumn("_at", best).groupBy("_m").agg(F.max(F.when(F.col("_at") == 1, F.col("_s"))).alias("_canon"), F.count("_s").alias("_degree"))
    work = work.drop("_w").join(of, "_m", "left")
    held = F.max(F.col("_s") == F.col("_canon")).over(Window.partitionBy("cell_id", "_m"))
    ambient = F.col("_degree") > max_slaves_per_master if max_slaves_per_master is not None else F.lit(False)
    other = (F.col("_s") != F.col("_canon")) & ~held
    work = work.withColumn("mispairing_reason", F.when(ambient, "ambient_master").when(other, "noncanonical_alpha").otherwise("ok"))
    work = work.withColumn("mispairing_flag", F.col("mispairing_reason") != "ok")
    out = work.select(*paired.columns, "mispairing_flag", "mispairing_reason")
    return out.where("not mispairing_flag").select(*paired.columns) if drop else out


def assign_singleton_ids(df: DataFrame, column: str, *, sentinel: int | None = None, order: str = "ord") -> DataFrame:
    """``column`` with each unclustered row (null, or ``sentinel``) in a cluster of its own, of a negative number.

    Rows are numbered by ranges of ``order``, so that no task sees them all.
    """
    alone = F.col(column).isNull() | ((F.col(column) == sentinel) if sentinel is not None else F.lit(False))
    scratch = Scratch(df.sparkSession, "singletons")
    few = scratch.cut(df.where(alone).repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    starts = few.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row for each range
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_start")
    numbered = few.join(starts, "_part").withColumn(column, (-nth).cast("long")).select(*df.columns)
    return df.where(~alone).withColumn(column, F.col(column).cast("long")).unionByName(numbered)


def cluster_eval(labels: DataFrame, true: str = "label_true", predicted: str = "label_pred", *, beta: float = 1.0) -> DataFrame:
    """Purities, raw and scaled from their floors, homogeneity, parsimony and their weighted harmonic mean, from the contingency table.

    Margins and joint counts are aggregates; one row each meets in the end.
    """
    cells = labels.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    of = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    entropy = lambda: F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    t = of("t").agg(F.sum("n").alias("total"), F.sum("m").alias("mt"), F.max("n").alias("largest"), F.count("*").alias("classes"), entropy().alias("hc"))
    p = of("p").agg(F.sum("m").alias("mp"), entropy().alias("hk"))
    one = t.crossJoin(p).crossJoin(cells.agg(entropy().alias("hck")))  # single rows
    n, hc = F.col("total"), F.col("hc")
    scaled = lambda x, least: F.when(least >= 1, 1.0).otherwise(F.try_divide(x - least, 1 - least))
    zero = F.lit(0.0)
    one = one.select(
        (F.col("mp") / n).alias("purity"), scaled(F.col("mp") / n, F.col("largest") / n).alias("normalized_purity"), (F.col("mt") / n).alias("inverse_purity"), scaled(F.col("mt") / n, F.col("classes") / n).alias("normalized_inverse_purity"),
        F.when(hc <= 1e-15, 1.0).otherwise(1 - F.greatest(zero, F.col("hck") - F.col("hk")) / hc).alias("homogeneity"),
        F.when(F.log(n) - hc <= 1e-15, 1.0).otherwise(1 - F.try_divide(F.greatest(zero, F.col("hck") - hc), F.log(n) - hc)).alias("parsimony"),
    )
    h, s = F.col("homogeneity"), F.col("parsimony")
    return one.withColumn("q_measure", F.when((h <= 0) | (s <= 0), 0.0).otherwise(F.try_divide((1 + beta) * h * s, beta * h + s)))
