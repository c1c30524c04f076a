"""k-mer and physicochemical profiles of junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clonotype import SAMPLE, strip_allele, weight


def kmers(text: Column, k: int, flank: int = 0) -> Column:
    """The k-mers of a string without ``flank`` characters at either end; none if it is too short."""
    core = F.when(F.length(text) > 2 * flank, F.substring(text, F.lit(flank + 1), F.length(text) - 2 * flank)).otherwise(F.lit(""))
    last = F.length(core) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.substring(core, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def explode_kmers(df: DataFrame, k: int, flank: int = 0) -> DataFrame:
    return df.withColumn("kmer", F.explode(kmers(F.col("junction_aa"), k, flank)))


def kmer_profile(df: DataFrame, k: int = 3, kind: str = "reads", *, by_locus: bool = True, flank: int = 0, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    x = explode_kmers(df, k, flank)
    keys = [*by, *([F.substring("v_call", 1, 3).alias("locus")] if by_locus else [])]
    return x.groupBy(*keys, "kmer").agg(F.sum(weight(kind)).alias("weight"))


def v_kmer_c_profile(df: DataFrame, k: int = 3, kind: str = "reads", *, keep_allele: bool = False, flank: int = 0, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    x = explode_kmers(df, k, flank)
    calls = [(F.col(c) if keep_allele else strip_allele(F.col(c))).alias(c) for c in ("v_call", "c_call")]
    return x.groupBy(*by, F.substring("v_call", 1, 3).alias("locus"), *calls, "kmer").agg(F.sum(weight(kind)).alias("weight"))


def kmer_cohort(df: DataFrame, k: int = 4, flank: int = 4, *, keep_allele: bool = False, sample: str = SAMPLE) -> DataFrame:
    """Distinct sample, V and k-mer: incidence for association tests."""
    v = F.col("v_call") if keep_allele else strip_allele(F.col("v_call"))
    return explode_kmers(df.where("v_call is not null"), k, flank).select(sample, v.alias("v_call"), "kmer").distinct()


#: Kyte-Doolittle hydropathy, charge and residue volume; fixed values.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
CHARGE = {"D": -1.0, "E": -1.0, "K": 1.0, "R": 1.0}
VOLUME = {"A": 88.6, "R": 173.4, "N": 114.1, "D": 111.1, "C": 108.5, "Q": 143.8, "E": 138.4, "G": 60.1, "H": 153.2, "I": 166.7, "L": 166.7, "K": 168.6, "M": 162.9, "F": 189.9, "P": 112.7, "S": 89.0, "T": 116.1, "W": 227.8, "Y": 193.6, "V": 140.0}
PROPERTIES: dict[str, dict[str, float]] = {"hydropathy": HYDROPATHY, "charge": {r: CHARGE.get(r, 0.0) for r in HYDROPATHY}, "volume": VOLUME}


def load_property_table(spark, path: str) -> dict[str, dict[str, float]]:
    """Scales by name from a table (tab-separated) with a row for each residue in its first column; lines with ``##`` are notes."""
    text = spark.read.text(path, wholetext=True).first()[0]  # some twenty rows
    lines = [x.split("\t") for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip() and not x.startswith("##")]
    return {name: {row[0].strip(): float(row[i]) for row in lines[1:] if row[i].strip()} for i, name in enumerate(lines[0]) if i}


def region(text: Column, name: str) -> Column:
    """``all``; ``trimmed``: without three residues at either end; ``center``: the middle five. Null where too short."""
    n = F.length(text)
    if name == "all":
        return text
    if name == "trimmed":
        return F.when(n > 6, F.substring(text, F.lit(4), n - 6))
    if name == "center":
        return F.when(n >= 5, F.substring(text, F.floor(n / 2).cast("int") - 1, F.lit(5)))
    raise ValueError(f"region must be all, trimmed or center, not {name!r}")


def mean_property(text: Column, values: dict[str, float]) -> Column:
    """Mean over the residues that have a value; null if none has."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    known = F.filter(F.transform(F.split(text, ""), lambda r: table[r]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def physchem_profile(df: DataFrame, group_by: tuple[str, ...] = ("v_call", "j_call"), where: str = "all", kind: str = "reads", *, properties: dict[str, dict[str, float]] | None = None, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Weighted group means of the clonotypes' mean properties, in long form."""
    properties = properties or PROPERTIES
    text = region(F.col("junction_aa"), where)
    x = df.withColumn("_w", weight(kind).cast("double")).select(*by, *group_by, "_w", *(mean_property(text, v).alias(k) for k, v in properties.items()))
    means = [F.try_divide(F.sum(F.when(F.col(k).isNotNull(), F.col(k) * F.col("_w"))), F.sum(F.when(F.col(k).isNotNull(), F.col("_w")))).alias(k) for k in properties]
    return x.groupBy(*by, *group_by).agg(*means).unpivot([*by, *group_by], list(properties), "property", "value").where("value is not null")
