"""Repertoire signatures: a fixed set of features of every sample and locus, in one pass over the cohort.

Features are computed in long form (sample, column, value) by aggregates over samples and loci, and laid out in the end: a
column is named ``vsig:<block>:<locus>:<feature>``. What a sample can't support is null, and ``vsig:mask:<locus>:<mask>`` says so.
Clonotypes weigh a concave function of their counts, so that one large clone isn't the whole profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clonotype import RESIDUES, SAMPLE, arcsine, log1p_floor, log10_floor, logit, strip_allele
from ..sources.scratch import Scratch
from .features import PROPERTIES, mean_property, region
from .rarefaction import estimate_d

LOCI = ("TRA", "TRB", "TRG", "TRD", "IGH", "IGK", "IGL")
#: Coverage at which diversity is compared.
COVERAGE = 0.2
WEIGHTS = {
    "log2p1": lambda x: F.log2(1 + x), "log1p": F.log1p, "anscombe": lambda x: F.sqrt(x + 0.375), "count": lambda x: x.cast("double"), "distinct": lambda x: F.lit(1.0),
}
#: Constant genes of the isotype classes, and the pairs of loci whose reads are compared.
ISOTYPES = {"IgM": ["IGHM"], "IgD": ["IGHD"], "IgG": ["IGHG1", "IGHG2", "IGHG3", "IGHG4"], "IgA": ["IGHA1", "IGHA2"], "IgE": ["IGHE"]}
PAIRS = (("TRA", "TRB"), ("TRG", "TRB"), ("TRD", "TRB"), ("IGK", "IGL"), ("IGH", "TRB"))
BY = (SAMPLE, "locus")


def work_frame(df: DataFrame, weight: str = "log2p1", by: tuple[str, ...] = BY) -> DataFrame:
    """``frequency`` as the share of the concave weight."""
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {', '.join(WEIGHTS)}, not {weight!r}")
    w = WEIGHTS[weight](F.col("duplicate_count"))
    return df.withColumn("_w", w).withColumn("frequency", F.coalesce(F.try_divide("_w", F.sum("_w").over(Window.partitionBy(*by))), F.lit(0.0))).drop("_w")


def clr_parts(parts: dict[str, Column], m: Column) -> dict[str, Column]:
    """Centred log-ratios of one row's parts; empty parts get the smaller of 0.5 / m and half the least part shared among them."""
    total = sum(parts.values(), F.lit(0.0))
    p = {k: F.try_divide(v, total) for k, v in parts.items()}
    zeros = sum(((x == 0).cast("int") for x in p.values()), F.lit(0))
    least = F.array_min(F.filter(F.array(*p.values()), lambda x: x > 0))
    fill = F.least(F.try_divide(F.lit(0.5), m), F.try_divide(0.5 * least, zeros))
    logs = {k: F.log(F.when(x == 0, fill).otherwise(x * (1 - F.coalesce(fill * zeros, F.lit(0.0))))) for k, x in p.items()}
    mean = sum(logs.values(), F.lit(0.0)) / len(parts)
    return {k: x - mean for k, x in logs.items()}


def _long(df: DataFrame, block: str, names: dict[str, Column], by: tuple[str, ...] = BY) -> DataFrame:
    """One row for each feature of each row."""
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in names.items()))
    locus = F.col("locus") if "locus" in by else F.lit("all")
    return df.select(SAMPLE, locus.alias("locus"), F.lit(block).alias("block"), F.inline(pairs))


def _stats(df: DataFrame) -> DataFrame:
    """Of the clean rows: reads, clonotypes, how many have one and two reads, the largest share."""
    n = F.col("duplicate_count")
    return df.groupBy(*BY).agg(F.sum(n).alias("reads"), F.count("*").alias("richness"), F.count_if(n == 1).alias("f1"), F.count_if(n == 2).alias("f2"), (F.max(n) / F.sum(n)).alias("top"))


def qc_block(raw: DataFrame, clean: DataFrame, germline: DataFrame | None = None) -> DataFrame:
    """The share of reads with junctions that can't be read, and of weight with genes that ``germline`` (``gene``) doesn't know."""
    rows = raw.groupBy(*BY).agg(F.count("*").alias("n"), F.sum("duplicate_count").alias("_all"))
    kept = clean.groupBy(*BY).agg(F.sum("duplicate_count").alias("_kept"))
    lost = 1 - F.coalesce(F.try_divide(F.coalesce("_kept", F.lit(0)), "_all"), F.lit(1.0))
    out = _long(rows.join(kept, list(BY), "left"), "qc", {"nonstd_aa_frac": logit(lost, F.greatest("n", F.lit(1)))})
    if germline is None:
        return out
    known, marked = germline.select(F.col("gene").alias("_g"), F.lit(True).alias("_known")).distinct(), clean
    for s in "vj":
        marked = marked.withColumn("_g", strip_allele(F.col(f"{s}_call"))).join(known, "_g", "left").withColumn(f"_{s}", F.col("_known").isNull()).drop("_g", "_known")
    share = marked.groupBy(*BY).agg(F.count("*").alias("n"), *(F.sum(F.when(F.col(f"_{s}"), F.col("frequency")).otherwise(0.0)).alias(s) for s in "vj"))
    return out.unionByName(_long(share, "qc", {f"{s}_fallback_frac": logit(F.col(s), F.col("n")) for s in "vj"}))


def depth_block(stats: DataFrame) -> DataFrame:
    f1, f2 = F.col("f1").cast("double"), F.col("f2").cast("double")
    unseen = F.when(f2 > 0, f1 * f1 / (2 * F.greatest(f2, F.lit(1.0)))).otherwise(f1 * (f1 - 1) / 2)
    return _long(stats, "depth", {"reads": log10_floor(F.col("reads")), "richness": log10_floor(F.col("richness")), "S_unseen": log1p_floor(unseen)})


def clon_block(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("richness"), F.lit(1)).cast("double")
    parts = {"f1": F.col("f1").cast("double"), "f2": F.col("f2").cast("double"), "f3plus": (F.col("richness") - F.col("f1") - F.col("f2")).cast("double")}
    c = clr_parts(parts, n)
    return _long(stats, "clon", {"f1": c["f1"], "f2": c["f2"], "top": logit(F.col("top"), F.col("reads"))})


def div_block(clean: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Hill numbers at one coverage, and clonality from them; null where a sample had to be extrapolated, with the mask ``estimable``."""
    sizes = clean.groupBy(*BY).agg(F.count("*").alias("n"), F.sum("duplicate_count").alias("reads"))
    few = clean.join(sizes.where("n >= 2 and reads >= 2").select(*BY), list(BY), "left_semi")
    est = estimate_d(few, "coverage", coverage, (0, 1, 2), se=False, by=BY)
    value = lambda q: F.max(F.when(F.col("order_q") == q, F.col("qD")))
    wide = est.groupBy(*BY).agg(*(value(q).alias(f"d{q}") for q in (0, 1, 2)), F.max(F.col("method") == "extrapolation").alias("beyond"), F.max("m").alias("m"))
    ok = F.coalesce(~F.col("beyond") & (F.col("m") <= 2.0 * F.col("reads")), F.lit(False))
    even = F.when(F.col("d0") > 1, F.log("d1") / F.log(F.greatest("d0", F.lit(1.0 + 1e-12)))).otherwise(0.0)
    masked = lambda c: F.when(ok, c)
    row = sizes.join(wide, list(BY), "left")
    names = {f"{q}D_c": masked(log10_floor(F.col(f"d{q}"))) for q in (1, 0, 2)} | {"clonality": masked(logit(F.least(F.greatest(1 - even, F.lit(0.0)), F.lit(1.0)), F.col("n")))}
    return _long(row, "div", names).unionByName(_long(row, "mask", {"estimable": ok.cast("double")}))


def len_block(work: DataFrame) -> DataFrame:
    """Weighted mean, deviation and skewness of junction lengths, centred first."""
    w, x = F.col("frequency"), F.length("junction_aa").cast("double")
    mean = work.groupBy(*BY).agg(F.sum(w * x).alias("_mean"))
    off = x - F.col("_mean")
    m = work.join(mean, list(BY)).groupBy(*BY, "_mean").agg(F.sum(w * off * off).alias("v"), F.sum(w * off * off * off).alias("s"))
    sd = F.sqrt("v")
    return _long(m, "len", {"mean": F.col("_mean"), "sd": sd, "skew": F.coalesce(F.try_divide(F.col("s"), sd * sd * sd), F.lit(0.0))})


def iso_block(work: DataFrame, full: bool = False) -> DataFrame:
    """Isotype shares of heavy chains as log-ratios, the uncalled share being a part."""
    call = strip_allele(F.col("c_call")) if "c_call" in work.columns else F.lit(None).cast("string")
    part = lambda genes: F.sum(F.when(call.isin(genes), F.col("frequency")).otherwise(0.0))
    of = work.where("locus = 'IGH'").groupBy(*BY).agg(F.count("*").alias("n"), *(part(g).alias(k) for k, g in ISOTYPES.items()))
    parts = {k: F.col(k) for k in ISOTYPES}
    # What is left after rounding of the sum counts as nothing.
    rest = 1 - sum(parts.values(), F.lit(0.0))
    c = clr_parts(parts | {"_uncalled": F.when(rest > 1e-12, rest).otherwise(0.0)}, F.col("n"))
    return _long(of, "iso", {k: c[k] for k in ISOTYPES if full or k != "IgE"})


def shm_block(work: DataFrame) -> DataFrame:
    if "v_identity" not in work.columns:
        return _long(work.select(*BY).distinct(), "shm", {"mean_v_identity": F.lit(None)})
    known = F.col("v_identity").isNotNull() & ~F.isnan("v_identity")
    of = work.groupBy(*BY).agg(F.sum(F.when(known, F.col("frequency") * F.col("v_identity"))).alias("x"), F.sum(F.when(known, F.col("frequency"))).alias("w"), F.count_if(known).alias("n"))
    return _long(of, "shm", {"mean_v_identity": logit(F.try_divide("x", "w"), F.col("n"))})


def pair_block(stats: DataFrame) -> DataFrame:
    """Log ratios of the reads of loci."""
    one = stats.groupBy(SAMPLE).agg(*(F.coalesce(F.sum(F.when(F.col("locus") == x, F.col("reads"))), F.lit(0)).alias(x) for x in LOCI))
    return _long(one, "pair", {f"log_{a}_{b}": F.log10((F.col(a) + 1) / (F.col(b) + 1)) for a, b in PAIRS}, (SAMPLE,))


def aa_block(work: DataFrame) -> DataFrame:
    """Weighted residue shares of junctions, variance-stabilised."""
    count = lambda r: F.length("junction_aa") - F.length(F.replace(F.col("junction_aa"), F.lit(r), F.lit("")))
    of = work.groupBy(*BY).agg(F.sum(F.length("junction_aa")).cast("double").alias("residues"), F.sum(F.length("junction_aa") * F.col("frequency")).alias("all"), *(F.sum(count(r) * F.col("frequency")).alias(f"of_{r}") for r in RESIDUES))
    return _long(of, "aa", {r: F.when(F.col("all") > 0, arcsine(F.try_divide(F.col(f"of_{r}"), F.col("all")), F.col("residues"))) for r in RESIDUES})


def pchem_block(work: DataFrame, regions: tuple[str, ...] = ("all", "center"), properties: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Weighted means of the junctions' mean properties."""
    properties = properties or PROPERTIES
    names = {f"{r}_{p}": mean_property(region(F.col("junction_aa"), r), v) for r in regions for p, v in properties.items()}
    x = work.select(*BY, "frequency", *(c.alias(k) for k, c in names.items()))
    mean = lambda k: F.try_divide(F.sum(F.when(F.col(k).isNotNull(), F.col(k) * F.col("frequency"))), F.sum(F.when(F.col(k).isNotNull(), F.col("frequency"))))
    return _long(x.groupBy(*BY).agg(*(mean(k).alias(k) for k in names)), "pchem", {k: F.col(k) for k in names})


#: Blocks of each tier.
TIERS = {"core": ("qc", "depth", "div", "clon", "len", "pair", "mask"), "standard": ("qc", "depth", "div", "clon", "len", "pair", "mask", "iso", "shm"), "full": ("qc", "depth", "div", "clon", "len", "pair", "mask", "iso", "shm", "aa", "pchem")}


def features(df: DataFrame, *, tier: str = "standard", coverage: float = COVERAGE, weight: str = "log2p1", germline: DataFrame | None = None) -> DataFrame:
    """``sample_id, locus, block, feature, value`` of every sample and locus of a cohort."""
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {', '.join(TIERS)}, not {tier!r}")
    needed = [c for c in (SAMPLE, "v_call", "j_call", "c_call", "junction_aa", "duplicate_count", "v_identity") if c in df.columns]
    raw = df.withColumn("locus", F.substring("v_call", 1, 3)).where(F.col("locus").isin(*LOCI)).select(*needed, "locus")
    raw = Scratch(df.sparkSession, "signature").cut(raw)  # every block reads it
    clean = raw.where((F.col("duplicate_count") > 0) & F.col("junction_aa").rlike(f"^[{RESIDUES}]+$"))
    work, stats = work_frame(clean, weight), _stats(clean)
    made = {
        "qc": lambda: qc_block(raw, work, germline), "depth": lambda: depth_block(stats), "div": lambda: div_block(clean, coverage), "clon": lambda: clon_block(stats), "len": lambda: len_block(work),
        "pair": lambda: pair_block(stats), "iso": lambda: iso_block(work, tier == "full"), "shm": lambda: shm_block(work), "aa": lambda: aa_block(work), "pchem": lambda: pchem_block(work),
    }
    out = None
    for block in (b for b in TIERS[tier] if b in made):
        part = made[block]()
        out = part if out is None else out.unionByName(part)
    return out


def columns(tier: str = "standard", loci: tuple[str, ...] = LOCI) -> list[str]:
    """All columns of a tier, in their order."""
    own = {
        "qc": ["nonstd_aa_frac"], "depth": ["reads", "richness", "S_unseen"], "div": ["1D_c", "0D_c", "2D_c", "clonality"], "clon": ["f1", "f2", "top"], "len": ["mean", "sd", "skew"], "mask": ["estimable"],
        "iso": [k for k in ISOTYPES if tier == "full" or k != "IgE"], "shm": ["mean_v_identity"], "aa": list(RESIDUES), "pchem": [f"{r}_{p}" for r in ("all", "center") for p in PROPERTIES],
    }
    out = []
    for block in TIERS[tier]:
        if block == "pair":
            out += [f"vsig:pair:all:log_{a}_{b}" for a, b in PAIRS]
        else:
            out += [f"vsig:{block}:{locus}:{f}" for locus in (("IGH",) if block == "iso" else loci) for f in own[block]]
    return out


def describe(spark, tier: str = "standard") -> DataFrame:
    """The columns of a tier: ``column, block, locus, feature``."""
    return spark.createDataFrame([(c, *c.split(":")[1:]) for c in columns(tier)], "column string, block string, locus string, feature string")


def vsig_cohort(df: DataFrame, *, tier: str = "standard", loci: tuple[str, ...] = LOCI, **options) -> DataFrame:
    """One row for each sample, with a column for each feature of the tier."""
    long = features(df, tier=tier, **options)
    name = F.concat_ws(":", F.lit("vsig"), "block", "locus", "feature")
    return long.withColumn("_c", name).groupBy(SAMPLE).pivot("_c", columns(tier, loci)).agg(F.first("value"))


def vsig(df: DataFrame, sample: str, **options) -> DataFrame:
    """The row of one sample."""
    return vsig_cohort(df.where(F.col(SAMPLE) == sample), **options)


def magnitude_scale(x: Column, rms: float) -> Column:
    """A block divided by one scale, not centred, so that no signal stays at 0; a scale that isn't positive counts as 1."""
    return x.cast("double") / (rms if rms > 0 else 1.0)


def apply(code: str, x: Column, m: Column | float | None = None) -> Column:
    """The transform of that name; shares need ``m``, the number that they are a share of."""
    plain = {"none": lambda c: c.cast("double"), "log10": log10_floor, "log1p": log1p_floor}
    shares = {"logit": logit, "arcsine": arcsine}
    if code in plain:
        return plain[code](x)
    if code == "clr":
        raise ValueError("clr takes all parts of a composition: see clr_parts")
    if code not in shares:
        raise ValueError(f"transform must be one of {', '.join((*plain, *shares))}, not {code!r}")
    if m is None:
        raise ValueError(f"{code} needs the number that its value is a share of")
    return shares[code](x, m)
