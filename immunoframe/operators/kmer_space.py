"""k-mer spaces: a vocabulary of (gapped, reduced) k-mers with weights and a basis, fitted on a cohort and kept.

Document frequencies, weights and projections are DataFrame aggregates and joins; the basis is Spark's distributed singular
value decomposition, and only it (columns times components) passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clonotype import RESIDUES, SAMPLE, strip_allele
from ..sources.scratch import Scratch

#: Residue groups of reduced alphabets by their size (Murphy, Wallqvist and Levy, 2000); fixed values.
ALPHABETS = {
    4: "LVIMC AGSTP FYW EDNQKRH", 8: "LVIMC AG ST P FYW EDNQ KR H", 10: "LVIM C A G ST P FYW EDNQ KR H", 15: "LVIM C A G S T P FY W E D N Q KR H", 20: " ".join(RESIDUES),
}


def reduced_alphabet(groups: int = 8) -> dict[str, str]:
    """Each residue's group, by the group's first residue."""
    if groups not in ALPHABETS:
        raise ValueError(f"alphabets have {', '.join(map(str, ALPHABETS))} groups, not {groups}")
    return {r: g[0] for g in ALPHABETS[groups].split() for r in g}


def alphabet_table(spark: SparkSession, groups: int = 8) -> DataFrame:
    return spark.createDataFrame(sorted(reduced_alphabet(groups).items()), "residue string, letter string")


def pattern_of(spec: str) -> list[int]:
    """The places of a pattern: ``x`` stands, a dot is any residue; the ends must stand."""
    if not spec or set(spec) - set("x.") or spec[0] != "x" or spec[-1] != "x":
        raise ValueError(f"a pattern has x and dots, with x at both ends: {spec!r}")
    return [i for i, c in enumerate(spec) if c == "x"]


def patterned(df: DataFrame, pattern: str, groups: int = 8, flank: int = 4) -> DataFrame:
    """``df`` with a row for each k-mer: of the V gene and the junction without ``flank`` residues at either end, in reduced letters."""
    places, letters = pattern_of(pattern), reduced_alphabet(groups)
    plain = F.translate(F.col("junction_aa"), "".join(letters), "".join(letters.values()))
    core = F.substring(plain, F.lit(flank + 1), F.greatest(F.length("junction_aa") - 2 * flank, F.lit(0)))
    n = F.length("_core") - len(pattern) + 1
    one = lambda i: F.concat(*(F.substring("_core", i + p, F.lit(1)) for p in places))
    rows = df.where(F.col("junction_aa").rlike(f"^[{RESIDUES}]+$") & F.col("v_call").isNotNull()).withColumn("_core", core).where(n > 0)
    return rows.withColumn("kmer", F.explode(F.transform(F.sequence(F.lit(1), n), one))).withColumn("kmer", F.concat_ws(":", strip_allele(F.col("v_call")), "kmer")).drop("_core")


@dataclass
class KmerSpace:
    """``vocabulary``: kmer, at, idf. ``basis``: at, component, loading. How k-mers are cut, and whether counts enter by their logarithm."""

    vocabulary: DataFrame
    basis: DataFrame
    pattern: str
    groups: int
    flank: int
    sublinear: bool

    def weighted(self, df: DataFrame, kind: str = "frequency", sample: str = SAMPLE) -> DataFrame:
        """``sample, at, x``: each sample's weights of known k-mers, of length 1."""
        df = df.groupBy(sample, "v_call", "junction_aa").agg(F.sum(kind).alias(kind))  # before junctions are cut
        tf = patterned(df, self.pattern, self.groups, self.flank).groupBy(sample, "kmer").agg(F.sum(kind).cast("double").alias("tf"))
        x = tf.join(self.vocabulary, "kmer").withColumn("x", (F.log1p("tf") if self.sublinear else F.col("tf")) * F.col("idf"))
        size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(sample)))
        return x.select(sample, "at", F.when(size > 0, F.col("x") / size).otherwise(0.0).alias("x"))

    def transform(self, df: DataFrame, kind: str = "frequency", sample: str = SAMPLE) -> DataFrame:
        """``sample, component, value``, and as component -1 the length of what the basis doesn't hold: 0 for a sample without known k-mers."""
        x = Scratch(df.sparkSession, "kmer-weights").cut(self.weighted(df, kind, sample))  # at most the vocabulary for each sample; read often
        projected = x.join(self.basis, "at").groupBy(sample, "component").agg(F.sum(F.col("x") * F.col("loading")).alias("value"))
        held = projected.groupBy(sample).agg(F.sum(F.col("value") * F.col("value")).alias("_in"))
        whole = df.select(sample).distinct().join(x.groupBy(sample).agg(F.sum(F.col("x") * F.col("x")).alias("_all")), sample, "left").join(held, sample, "left")
        left = F.coalesce("_all", F.lit(0.0)) - F.coalesce("_in", F.lit(0.0))
        return projected.unionByName(whole.select(sample, F.lit(-1).alias("component"), F.sqrt(F.greatest(left, F.lit(0.0))).alias("value")))


def vocabulary(df: DataFrame, pattern: str = "xxxx", groups: int = 8, flank: int = 4, *, min_df: float = 0.02, max_df: float = 0.8, max_columns: int = 50_000, sample: str = SAMPLE) -> DataFrame:
    """``kmer, df, idf, at``: k-mers that enough and not too many samples hold; beyond ``max_columns`` the most frequent."""
    held = patterned(df.select(sample, "v_call", "junction_aa").distinct(), pattern, groups, flank).groupBy("kmer").agg(F.countDistinct(sample).alias("df"))
    n = df.agg(F.countDistinct(sample).alias("_n"))  # one row
    kept = held.crossJoin(F.broadcast(n)).where((F.col("df") >= min_df * F.col("_n")) & (F.col("df") <= max_df * F.col("_n")))
    kept = kept.orderBy(F.desc("df"), "kmer").limit(max_columns)  # the size of the vocabulary is a parameter
    at = F.row_number().over(Window.orderBy(F.desc("df"), "kmer")) - 1  # at most max_columns rows
    return kept.withColumn("at", at).select("kmer", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"), "at")


def fit_kmer_space(
    df: DataFrame, *, pattern: str = "xxxx", groups: int = 8, flank: int = 4, kind: str = "frequency", min_df: float = 0.02, max_df: float = 0.8, max_columns: int = 50_000, components: int = 32, sublinear: bool = True, sample: str = SAMPLE
) -> KmerSpace:
    """The space of a cohort. Signs are fixed so that each component's largest loading is positive."""
    spark = df.sparkSession
    words = vocabulary(df, pattern, groups, flank, min_df=min_df, max_df=max_df, max_columns=max_columns, sample=sample).drop("df")
    words = Scratch(spark, "vocabulary").cut(words)
    size = words.count()
    empty = spark.createDataFrame([], "at int, component int, loading double")
    space = KmerSpace(words, empty, pattern, groups, flank, sublinear)
    if not size:
        return space
    scratch = Scratch(spark, "kmer-space")
    rows = scratch.cut(space.weighted(df, kind, sample).groupBy(sample).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")))  # at most the vocabulary; read often
    matrix = RowMatrix(rows.select("v").rdd.map(lambda r: Vectors.sparse(size, [x["at"] for x in r["v"]], [x["x"] for x in r["v"]])), numCols=size)
    v = matrix.computeSVD(min(components, size, rows.count()), computeU=False).V.toArray()
    v = v * [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in v.T]
    loadings = [(i, k, float(x)) for i, row in enumerate(v) for k, x in enumerate(row)]
    space.basis = spark.createDataFrame(loadings, "at int, component int, loading double")
    return space


def save_kmer_space(space: KmerSpace, path: str) -> None:
    space.vocabulary.write.parquet(f"{path}/vocabulary")
    space.basis.write.parquet(f"{path}/basis")
    spark = space.vocabulary.sparkSession
    spark.createDataFrame([(space.pattern, space.groups, space.flank, space.sublinear)], "pattern string, groups int, flank int, sublinear boolean").coalesce(1).write.json(f"{path}/how")


def load_kmer_space(spark: SparkSession, path: str) -> KmerSpace:
    how = spark.read.json(f"{path}/how").first()
    return KmerSpace(spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/basis"), how["pattern"], int(how["groups"]), int(how["flank"]), how["sublinear"])
