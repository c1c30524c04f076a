"""Registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clonotype as C
from ..operators import association as assoc
from ..operators import batch, cluster, diversity, dynamics, enrichment, features, filters, germline, kernels, kmer_space, neighbours, overlap, pooling, ranks, rarefaction, recombination, sampling, scenarios, signature, singlecell, usage
from ..sources import readers
from ..sources.scratch import Scratch
from . import adapter as A
from . import toy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Floats with nine significant digits, so that engines that sum in another order agree; what is below 1e-12 is 0."""
    digits = lambda c: F.when(F.abs(c) < 1e-12, 0.0).when(F.col(c).isNotNull(), F.format_string("%.8e", c).cast("double")).alias(c)
    return df.select(*(digits(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _decimals(df: DataFrame, **digits: int) -> DataFrame:
    """Columns whose last digits depend on how logarithms of factorials are computed, to fewer decimals."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
    return f


def _rows(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "ord", "duplicate_count", "frequency")


@query
def schema_normalize(s, d):
    c = A.clonotypes(s, d).withColumn("duplicate_count", F.concat(F.col("duplicate_count").cast("string"), F.lit(".7"))).drop("d_call", "frequency")
    return C.normalize(c, keep=("ord",), recompute=True).select("sample_id", "ord", "v_call", "d_call", "junction_aa", "duplicate_count", "frequency")


@query
def scalar_expressions(s, d):
    c = A.clonotypes(s, d)
    v, nt, n, f = (F.col(x) for x in ("v_call", "junction_nt", "duplicate_count", "frequency"))
    return c.select(
        "ord", C.locus_of(v).alias("locus"), C.strip_allele(v).alias("genes"), C.resolve_gene(v).alias("gene"), C.isotype(F.col("c_call")).alias("isotype"), C.size_class(n).alias("size_class"),
        C.poisson_capture(f, 100.0).alias("capture"), C.reverse_complement(nt).alias("reverse"), C.log10_floor(n).alias("log10"), C.log1p_floor(n).alias("log1p"),
        C.logit(f, 1000.0).alias("logit"), C.arcsine(f, 1000.0).alias("arcsine"), C.reference_z(n, 25.0, 10.0).alias("z"),
    )


@query
def translate_junction(s, d):
    nt = A.reads(s, d).select(F.explode(F.array("junction_nt", F.expr("substr(junction_nt, 1, length(junction_nt) - 1)"), F.expr("substr(junction_nt, 3)"), F.expr("substr(junction_nt, 1, length(junction_nt) - 7)"))).alias("junction_nt"))
    return nt.distinct().select("junction_nt", C.translate_junction(F.col("junction_nt")).alias("junction_aa"))


@query
def clr_usage(s, d):
    u = usage.segment_usage(A.clonotypes(s, d), "V", by_locus=False)
    return C.clr(u, "weight", ("sample_id",)).select("sample_id", "v_call", "clr")


@query
def robust_loc_scale(s, d):
    return C.robust_loc_scale(usage.segment_usage(A.clonotypes(s, d), "V", by_locus=False).withColumn("weight", F.col("weight").cast("double")), "weight", ("sample_id",))


@query
def filter_productive(s, d):
    return _rows(filters.filter_productive(A.clonotypes(s, d)))


@query
def filter_unproductive(s, d):
    return _rows(filters.filter_productive(A.clonotypes(s, d), "unproductive", renormalise=False))


@query
def filter_functional_genes(s, d):
    genes = s.sql("select concat('TRBV', id) gene, case when id % 4 = 0 then 'P' else 'F' end functional from range(1, 20)")
    return _rows(filters.filter_functional_genes(A.clonotypes(s, d), genes, segments=("V",)))


@query
def filter_length(s, d):
    return _rows(filters.filter_length(A.clonotypes(s, d), 11, 13))


@query
def filter_frequency(s, d):
    return _rows(filters.filter_frequency(A.clonotypes(s, d), min_freq=3e-4, top=0.8))


@query
def filter_segment(s, d):
    return _rows(filters.filter_segment(A.clonotypes(s, d), v=["TRBV1", "TRBV2"], j="TRBJ1"))


@query
def filter_by_sample(s, d):
    c = A.clonotypes(s, d)
    return _rows(filters.filter_by_sample(c.where("sample_id != 'S00'"), A.one(c, "S00")))


@query
def decontaminate(s, d):
    return _rows(filters.decontaminate(A.clonotypes(s, d), ratio=3.0, measure="reads", key=("junction_aa", "j_call")))


@query
def sanitise_dropped(s, d):
    return filters.sanitise(A.clonotypes(s, d))[1]


@query
def select_top(s, d):
    return _rows(sampling.select_top(A.clonotypes(s, d), 25))


@query
def downsample_reads(s, d):
    drawn = sampling.downsample(A.clonotypes(s, d).withColumn("all", F.col("duplicate_count")), 500, part=200)
    return drawn.groupBy("sample_id").agg(F.sum("duplicate_count").alias("reads"), F.count_if(F.col("duplicate_count") > F.col("all")).alias("overdrawn"))


@query
def downsample_clones(s, d):
    return sampling.downsample(A.clonotypes(s, d), 40, "clones").groupBy("sample_id").agg(F.count("*").alias("clones"))


@query
def correct_errors(s, d):
    return _rows(sampling.correct(A.clonotypes(s, d).withColumn("junction_nt", F.expr(A.MUTATED)), 2, 0.2))


@query
def pool_aa(s, d):
    return pooling.pool_samples(A.clonotypes(s, d), "aa", reads=A.reads(s, d))


@query
def pool_strict(s, d):
    return pooling.pool_samples(A.clonotypes(s, d, dealt=pooling.KEYS["strict"]), "strict", reads=A.reads(s, d))


@query
def join_samples(s, d):
    return pooling.join_samples(A.clonotypes(s, d), "aaVJ", 3)


@query
def track_clonotypes(s, d):
    return pooling.track_clonotypes(A.clonotypes(s, d), ["S01", "S02", "S03"], key=("junction_aa",))


@query
def diversity_stats(s, d):
    return diversity.diversity_stats(A.clonotypes(s, d)).drop("efron_thisted")


@query
def efron_thisted(s, d):
    return diversity.diversity_stats(A.clonotypes(s, d)).select("sample_id", "efron_thisted")


@query
def hill_numbers(s, d):
    return diversity.hill(A.clonotypes(s, d))


@query
def count_spectrum(s, d):
    return diversity.spectrum(A.clonotypes(s, d))


@query
def segment_usage_v(s, d):
    return usage.segment_usage(A.clonotypes(s, d), "V")


@query
def segment_usage_d(s, d):
    return usage.segment_usage(A.clonotypes(s, d), "D", "unique")


@query
def segment_usage_j(s, d):
    return usage.segment_usage(A.clonotypes(s, d), "J", "freq")


@query
def vj_usage(s, d):
    return usage.vj_usage(A.clonotypes(s, d))


@query
def spectratype(s, d):
    return usage.spectratype(A.clonotypes(s, d))


@query
def vj_spectratype(s, d):
    return usage.vj_spectratype(A.clonotypes(s, d), "nt")


@query
def shm_spectrum(s, d):
    return usage.shm_spectrum(A.clonotypes(s, d))


@query
def shm_summary(s, d):
    return usage.shm_summary(A.clonotypes(s, d).where("v_identity is not null and c_call is not null"), "reads")


@query
def kmer_profile(s, d):
    return features.kmer_profile(A.clonotypes(s, d))


@query
def v_kmer_c_profile(s, d):
    return features.v_kmer_c_profile(A.clonotypes(s, d), 4, by=())


@query
def kmer_cohort(s, d):
    return features.kmer_cohort(A.clonotypes(s, d), 3, 3)


@query
def physchem_profile(s, d):
    return _decimals(features.physchem_profile(A.clonotypes(s, d), ("j_call",), "center", properties={"hydropathy": features.HYDROPATHY}), value=6)


@query
def overlap_pair(s, d):
    c = A.clonotypes(s, d)
    return overlap.overlap_pair(A.one(c, "S01"), A.one(c, "S02"), ("junction_aa",))


@query
def overlap_cohort(s, d):
    return overlap.cohort_overlap(A.clonotypes(s, d), ("junction_aa",))


@query
def pairwise_distances(s, d):
    return overlap.pairwise_distances(A.reads(s, d), "F", ("junction_aa", "j_call"))  # sums of reads are those of clonotypes


@query
def pairwise_distances_fuzzy(s, d):
    return _decimals(overlap.pairwise_distances(A.reads(s, d), scope="1,0,0,1"), distance=5)


@query
def sample_layout(s, d):
    """Distances of the laid out samples, whose given distances are those of points in a plane."""
    at = A.clonotypes(s, d).groupBy("sample_id").agg(F.avg(F.length("junction_aa")).alias("x"), F.avg(F.log("duplicate_count")).alias("y"))
    grid = at.select(*(F.col(c).alias(c + "a") for c in at.columns)).crossJoin(at.select(*(F.col(c).alias(c + "b") for c in at.columns)))  # a row for each distance
    dist = grid.select(F.col("sample_ida").alias("sample_a"), F.col("sample_idb").alias("sample_b"), F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")).alias("distance"))
    out = cluster.layout(Scratch(s, "layout"), dist)
    x, y = (out.select(*(F.col(c).alias(f"{c}_{k}") for c in out.columns)) for k in "ab")
    far = F.hypot(F.col("mds1_a") - F.col("mds1_b"), F.col("mds2_a") - F.col("mds2_b"))
    return x.crossJoin(y).select("sample_a", "sample_b", F.round(far, 5).alias("distance"))


@query
def sample_groups(s, d):
    """Average linkage of distances that are those of a tree: batch, then allele."""
    at = A.samples(s, d).select("sample_id", "batch", "hla_1")
    grid = at.select(*(F.col(c).alias(c + "a") for c in at.columns)).crossJoin(at.select(*(F.col(c).alias(c + "b") for c in at.columns)))  # a row for each distance
    far = F.when(F.col("batcha") != F.col("batchb"), 1.0).when(F.col("hla_1a") != F.col("hla_1b"), 0.5).when(F.col("sample_ida") != F.col("sample_idb"), 0.25).otherwise(0.0)
    dist = grid.select(F.col("sample_ida").alias("sample_a"), F.col("sample_idb").alias("sample_b"), far.alias("distance"))
    return cluster.groups(Scratch(s, "groups"), dist, 4, small=8)


@query
def sample_linkage(s, d):
    """The nearest two samples, the first merge of the average linkage of their distances."""
    merges = cluster.linkage(Scratch(s, "linkage"), overlap.pairwise_distances(A.reads(s, d), "F", ("junction_aa", "j_call")), small=8)
    return merges.orderBy("height", "cluster_a", "cluster_b").limit(1).select("cluster_a", "cluster_b", "height", "size_a", "size_b")


@query
def germline_audit(s, d):
    return germline.validate_germline(A.germline(s, d))


@query
def germline_joints(s, d):
    """How many J alleles each D can't be joined with."""
    return germline.forbidden_dj_pairs(A.germline(s, d)).groupBy("d_allele").agg(F.count("*").alias("n"))


@query
def fuzzy_overlap(s, d):
    c = A.clonotypes(s, d)
    return overlap.fuzzy_overlap(A.one(c, "S01"), A.one(c, "S02"), "1,1,1,1")


@query
def fuzzy_overlap_metrics(s, d):
    c = A.clonotypes(s, d)
    return overlap.fuzzy_overlap_metrics(A.one(c, "S01"), A.one(c, "S02"))


@query
def metaclonotypes(s, d):
    return neighbours.metaclonotypes(A.clonotypes(s, d).where("not junction_aa rlike '[*_]'"))


@query
def near_pairs_two(s, d):
    c = A.clonotypes(s, d)
    x, y = (A.one(c, n).withColumn("junction_aa", F.expr(A.SHORT)) for n in ("S01", "S02"))
    return neighbours.near_pairs(x, y, scope="2,0,0,2")


@query
def design_binary(s, d):
    return assoc.binary(A.samples(s, d), "cmv")


@query
def design_categorical(s, d):
    return assoc.categorical(A.samples(s, d), "batch", min_level_size=2)


@query
def design_hla(s, d):
    return assoc.hla_alleles(A.samples(s, d), ["hla_1", "hla_2"], resolution=1)


@query
def design_zygosity(s, d):
    return assoc.zygosity(A.samples(s, d), "hla_1", "hla_2")


@query
def select_candidates(s, d):
    return assoc.select_candidates(A.clonotypes(s, d), min_share=0.2)


@query
def fisher_association(s, d):
    return assoc.association(A.clonotypes(s, d), assoc.binary(A.samples(s, d), "cmv"), ("junction_aa",))


@query
def cmh_association(s, d):
    meta = A.samples(s, d)
    design = assoc.binary(meta, "cmv").join(meta.select("sample_id", "batch"), "sample_id")
    return assoc.cmh(assoc.contingency(A.clonotypes(s, d), design, ("junction_aa",), stratum="batch"), ["junction_aa"]).drop("p_value")


@query
def resolve_chains(s, d):
    return singlecell.resolve_chains(A.cells(s, d)).select("cell_id", "sequence_id", "locus", "duplicate_count", "umi_count")


@query
def pair_chains(s, d):
    return singlecell.pair_chains(A.cells(s, d))


@query
def chain_multiplicity(s, d):
    return singlecell.chain_multiplicity(A.cells(s, d))


@query
def cluster_eval(s, d):
    e = A.table(s, d, "embeddings")
    return singlecell.cluster_eval(e.select(F.col("label").alias("label_true"), (F.col("vec_id") % 7).alias("label_pred")))


@query
def sample_coverage(s, d):
    return _decimals(rarefaction.sample_coverage(A.clonotypes(s, d), [100, 1000, 2500.5, 10**6]), sample_coverage=5)


@query
def asymptotic_diversity(s, d):
    return rarefaction.asymptotic_diversity(A.clonotypes(s, d), se=False).drop("se", "lo", "hi")


@query
def inext(s, d):
    return _decimals(rarefaction.inext(A.clonotypes(s, d), sizes=[50, 700], se=False).drop("qD_lo", "qD_hi"), sample_coverage=5, qD=4)


@query
def estimate_d(s, d):
    return rarefaction.estimate_d(A.clonotypes(s, d), "size", 10.0**6, (0, 2), se=False).drop("qD_lo", "qD_hi")


@query
def inext_coverage(s, d):
    return rarefaction.inext_coverage(A.clonotypes(s, d), (0, 2), coverages=[0.3, 0.999], nboot=5).where("qD between qD_lo and qD_hi").select("sample_id", "order_q", "sample_coverage")


def _tables(s, d):
    return assoc.contingency(A.clonotypes(s, d), assoc.binary(A.samples(s, d), "cmv"), ("junction_aa",)).select(*"abcd").distinct()


@query
def fisher_minlike(s, d):
    return _tables(s, d).withColumn("p_value", assoc.fisher_p(*(F.col(c) for c in "abcd"), "minlike"))


@query
def fisher_two_sided(s, d):
    return _tables(s, d).withColumn("p_value", assoc.fisher_p(*(F.col(c) for c in "abcd"), "two-sided"))


@query
def bayes_tables(s, d):
    cells = [F.col(c) for c in "abcd"]
    post = assoc.bayes_logodds(*cells)
    return _tables(s, d).select(*cells, *(post[c].alias(c) for c in ("logor", "se", "ci_lo", "ci_hi")), assoc.bayes_bf(*cells).alias("bf"), assoc.chi2_stat(*cells).alias("chi2"))


@query
def permutation_test(s, d):
    design = assoc.binary(A.samples(s, d), "cmv")
    held = assoc.features(A.clonotypes(s, d), ("v_call",), productive=False)
    p = assoc.permutation_p(held, design, ("v_call",), n_perm=200)
    return p.select("v_call", "level", "a", "p_value")


@query
def fuzzy_features(s, d):
    return assoc.fuzzy_features(A.clonotypes(s, d), ("junction_aa", "j_call")).groupBy("junction_aa", "j_call").agg(F.count("*").alias("incidence"))


@query
def cooccurrence(s, d):
    return assoc.cooccurrence(A.clonotypes(s, d), chain_a="TRB", chain_b="IGH", key=("v_call",))


@query
def stratified_design(s, d):
    return assoc.stratified(A.samples(s, d), "cmv", "batch")


def _two(s, d):
    c = A.clonotypes(s, d)
    return A.one(c, "S01"), A.one(c, "S02")


def _two_read(s, d):
    """Two samples for sums by key alone, which reads have as clonotypes do."""
    c = A.reads(s, d)
    return A.one(c, "S01"), A.one(c, "S02")


@query
def pair_dynamics(s, d):
    return _decimals(dynamics.test_pair(*_two(s, d), key=("v_call", "j_call"), neff=3000.0, alpha=0.2), p_value=6, q_value=6)


@query
def expansion(s, d):
    return dynamics.expansion_test(*_two_read(s, d), key=("v_call", "j_call"), dispersion=0.2, alpha=0.5)


@query
def expansion_dispersion(s, d):
    return dynamics.expansion_test(*_two_read(s, d), key=("v_call",)).select("v_call", "count_a", "count_b", (F.col("dispersion") > 0).alias("fitted"))


@query
def effective_size(s, d):
    a, b = _two(s, d)
    return s.createDataFrame([(dynamics.estimate_neff(a, b, key=("junction_aa",), bins=6, min_bin=5) > 0,)], "positive boolean")


@query
def metaclonotype_dynamics(s, d):
    return dynamics.test_metaclonotypes(*_two(s, d), neff=3000.0).select("meta", "count_a", "count_b")


@query
def capture_rates(s, d):
    return dynamics.capture_rates(*_two(s, d), key=("junction_aa",), group="j_call").drop("ci_lo", "ci_hi")


def _donors(s, d):
    c = A.clonotypes(s, d).withColumn("donor", F.expr("cast(substr(sample_id, 2) as int) div 2")).withColumn("g", F.expr("case when ord % 2 = 0 then 'x' else 'y' end"))
    first = F.expr("cast(substr(sample_id, 2) as int) % 2 = 0")
    return dynamics.capture_rates(c.where(first), c.where(~first), key=("junction_aa",), group="g", donor="donor")


@query
def capture_paired(s, d):
    return dynamics.capture_paired_test(_donors(s, d)).drop("p_value")


@query
def capture_model(s, d):
    return dynamics.capture_test(_donors(s, d)).select("term", (F.col("p_value") <= 1).alias("tested"))


def _with_batch(s, d):
    return A.clonotypes(s, d).join(A.samples(s, d).select("sample_id", "batch"), "sample_id")


@query
def vj_correction_location(s, d):
    return batch.correct_vj_usage(_with_batch(s, d))


@query
def vj_correction_sigmoid(s, d):
    return batch.correct_vj_usage(_with_batch(s, d), weighted=False, transform="sigmoid")


@query
def vj_correction_applied(s, d):
    c = A.clonotypes(s, d)
    out = batch.apply_vj_correction(c, batch.correct_vj_usage(_with_batch(s, d)), scope="v")
    return out.groupBy("sample_id").agg(F.sum("duplicate_count").alias("reads"), F.sum("frequency").alias("frequency"))


@query
def neighbour_enrichment(s, d):
    c = A.clonotypes(s, d).withColumn("junction_aa", F.expr(A.SHORT))
    return enrichment.tcrnet(A.one(c, "S01"), A.one(c, "S02").select("junction_aa"))


@query
def neighbour_enrichment_model(s, d):
    scratch = Scratch(s, "enrichment")
    c = A.clonotypes(s, d).withColumn("junction_aa", F.expr(A.SHORT)).withColumn("v_call", F.expr("substr(v_call, 1, 4)")).withColumn("j_call", F.expr("substr(j_call, 1, 4)"))
    c = scratch.cut(c.select("sample_id", "v_call", "j_call", "junction_aa", "duplicate_count"))
    balls = c.select("junction_aa", "v_call", "j_call").distinct().withColumn("pgen_ball", F.expr("1e-3 * length(junction_aa)"))
    return enrichment.alice(c, balls, min_degree=2, scratch=scratch).drop("q_value")


@query
def similarity_overlap(s, d):
    return enrichment.similarity_overlap(*_two(s, d))


@query
def similarity_overlap_morisita(s, d):
    return enrichment.similarity_overlap(*_two(s, d), metric="morisita", tau=2.0)


@query
def residue_overlap(s, d):
    return kernels.residue_overlap(*_two(s, d), tau=0.5)


@query
def functional_diversity(s, d):
    return enrichment.functional_diversity(A.clonotypes(s, d))


@query
def flag_mispairing(s, d):
    return singlecell.flag_mispairing(singlecell.pair_chains(A.cells(s, d)), max_slaves_per_master=4)


@query
def singleton_ids(s, d):
    e = A.table(s, d, "events").select("event_id", F.expr("case when event_id % 3 = 0 then null when event_id % 7 = 0 then -1 else event_id % 5 end").alias("cluster"))
    return singlecell.assign_singleton_ids(e, "cluster", sentinel=-1, order="event_id")


def _signature(*blocks):
    def run(s, d):
        return signature.features(A.clonotypes(s, d), tier="full").where(F.col("block").isin(*blocks))

    return run


for _name, _blocks in {"depth": ("depth",), "clones": ("clon",), "lengths": ("len",), "isotypes": ("iso",), "mutation": ("shm",), "pairs": ("pair",), "residues": ("aa",), "quality": ("qc",)}.items():
    _f = _signature(*_blocks)
    _f.__name__ = f"signature_{_name}"
    query(_f)


@query
def signature_properties(s, d):
    return signature.features(A.clonotypes(s, d), tier="full").where("block = 'pchem' and feature = 'all_hydropathy'")


@query
def signature_mask(s, d):
    return signature.features(A.clonotypes(s, d)).where("block = 'mask'")


@query
def signature_wide(s, d):
    return signature.vsig_cohort(A.clonotypes(s, d), tier="core", loci=("TRB",)).select("sample_id", F.col("`vsig:depth:TRB:reads`").alias("reads"), F.col("`vsig:pair:all:log_IGH_TRB`").alias("ratio"), F.col("`vsig:len:TRB:mean`").alias("length"))


def _junctions(s, d):
    return A._select(A.table(s, d, "lineitem"), "lineitem", toy.JUNCTIONS)


def _residues(s, d):
    x = _junctions(s, d).where("length(junction_nt) % 3 = 0").select(C.translate(F.col("junction_nt")).alias("junction_aa"))
    return x.where("not contains(junction_aa, '*')").distinct()


@query
def pgen_nt_vj(s, d):
    return recombination.pgen_nt(_junctions(s, d), toy.VJ)


@query
def pgen_nt_vdj(s, d):
    return recombination.pgen_nt(_junctions(s, d), toy.VDJ)


@query
def pgen_nt_genes(s, d):
    x = _junctions(s, d).withColumns({"v_call": F.expr("case when junction_nt like 'TGT%' then 'V1' else 'V2*01' end"), "j_call": F.expr("case when junction_nt like '%TTTC' then 'J1*01' else 'J2' end")})
    return recombination.pgen_nt(x, toy.VDJ, v="v_call", j="j_call")


@query
def pgen_aa_vj(s, d):
    return recombination.pgen_aa(_residues(s, d), toy.VJ)


@query
def pgen_aa_vdj(s, d):
    return recombination.pgen_aa(_residues(s, d), toy.VDJ)


@query
def pgen_ball(s, d):
    return recombination.pgen_ball(_residues(s, d), toy.VDJ)


@query
def pgen_fit(s, d):
    return recombination.model_fit(recombination.pgen_nt(_junctions(s, d), toy.VJ))


@query
def pgen_histogram(s, d):
    return recombination.pgen_spectrum(recombination.pgen_nt(_junctions(s, d), toy.VDJ), width=1.0)


@query
def generated(s, d):
    return recombination.generate(s, toy.VDJ, 2500, seed=3).groupBy("v_call", "j_call").agg((F.count("*") > 0).alias("drawn"))


@query
def model_genes(s, d):
    return recombination.gene_marginal(recombination.marginals_frame(s, toy.VJ), "j")


@query
def model_entropy(s, d):
    return recombination.entropy_table(recombination.marginals_frame(s, toy.VDJ))


@query
def model_total_entropy(s, d):
    return recombination.total_entropy(recombination.marginals_frame(s, toy.VDJ))


@query
def model_information(s, d):
    return recombination.mutual_information(recombination.marginals_frame(s, toy.VJ))


@query
def model_distance(s, d):
    return recombination.compare_models(recombination.marginals_frame(s, toy.VJ), recombination.marginals_frame(s, toy.VDJ))


@query
def model_usage(s, d):
    c = A.clonotypes(s, d).select(F.expr("case when v_call like 'TRB%' then 'V1*01' else 'V1, V2*02' end").alias("v_call"), F.expr("case when j_call like 'TRB%' then 'J2' end").alias("j_call"))
    return recombination.gene_marginal(recombination.marginals_frame(s, recombination.usage_rescaled(toy.VDJ, c)), "v")


@query
def kmer_vocabulary(s, d):
    return kmer_space.vocabulary(A.reads(s, d), "xx.x", 8, 2, min_df=0.1, max_df=0.9).drop("at")


@query
def kmer_projection(s, d):
    c = A.clonotypes(s, d)
    space = kmer_space.fit_kmer_space(c, pattern="xx", groups=4, min_df=0.2, max_df=0.9, components=3)
    got = space.transform(c)
    return got.groupBy("sample_id").agg(F.sum(F.col("value") * F.col("value")).alias("length"))


@query
def shm_entropy(s, d):
    return usage.shm_entropy(A.clonotypes(s, d))


@query
def pgen_pattern(s, d):
    x = _residues(s, d).select(F.concat(F.lit("C"), F.lit("X"), F.expr("substr(junction_aa, 3)")).alias("pattern")).where("length(pattern) > 2").distinct()
    return recombination.pgen_degenerate(x, toy.VDJ)


@query
def best_scenario_vj(s, d):
    return scenarios.best_scenarios(_junctions(s, d), toy.VJ).select(F.col("s").alias("junction_nt"), "p")


@query
def best_scenario_vdj(s, d):
    return scenarios.best_scenarios(_junctions(s, d), toy.VDJ).select(F.col("s").alias("junction_nt"), "p")


@query
def scenario_counts(s, d):
    return scenarios.expected_counts(_junctions(s, d), toy.VDJ).where("kind in ('len0', 'len1')").select("kind", "piece", "x")


@query
def scenario_fit(s, d):
    return scenarios.expected_counts(_junctions(s, d), toy.VJ).where("kind = 'fit'").select("piece", "x")


@query
def inferred_genes(s, d):
    fitted, _ = scenarios.infer(_junctions(s, d), toy.VDJ, rounds=1)
    table = recombination.marginals_frame(s, fitted)
    return table.where("event in ('v', 'j')").select("event", "value", "p")


@query
def inferred_joint(s, d):
    fitted, _ = scenarios.infer(_junctions(s, d), toy.VJ, rounds=1)
    return recombination.marginals_frame(s, fitted).where("event = 'j'").select("parent", "value", "p")


@query
def read_other_orders(s, d):
    """The clonotypes written as exchange tables with columns in two orders and under other names, and read back in one call."""
    scratch = Scratch(s, "exchange")
    c = A.clonotypes(s, d).where("junction_aa not like '%*%' and junction_aa not like '%\\_%'")
    c = scratch.cut(c.select("sample_id", "v_call", "j_call", "junction_aa", "junction_nt", "duplicate_count", "ord"))
    one = c.where("ord % 2 = 0").select("v_call", "junction_nt", "junction_aa", "j_call", "duplicate_count", "sample_id", F.expr("if(ord % 10 = 4, 'n/a', string(ord % 7))").alias("note"))
    two = c.where("ord % 2 = 1").select(F.col("duplicate_count").alias("reads"), "sample_id", F.col("j_call").alias("j_gene"), F.col("junction_aa").alias("cdr3_aa"), F.col("v_call").alias("v_gene"), F.col("junction_nt").alias("junction"))
    for df, name in ((one, "one"), (two, "two")):
        df.write.csv(f"{scratch.base}/{name}", sep="\t", header=True, compression="gzip" if name == "two" else "none")
    scratch.drop(c)
    back = readers.read_airr(s, [f"{scratch.base}/one", f"{scratch.base}/two"], collapsed=False, keep=("note",))
    return back.groupBy("sample_id", "v_call").agg(F.count("*").alias("n"), F.sum("duplicate_count").alias("reads"), F.countDistinct("junction_nt", "junction_aa", "j_call").alias("junctions"), F.count_if(F.col("note") == "n/a").alias("notes"))


@query
def pgen_summary(s, d):
    compared = recombination.compare_pgen(_junctions(s, d), toy.VJ, toy.VDJ)
    return recombination.pgen_summary(compared.withColumns({c: F.round(c, 9) for c in ("log10_a", "log10_b", "delta_log10")}))  # so that ties are ties in both engines


@query
def exact_quantiles(s, d):
    scratch, shares = Scratch(s, "quantiles"), [0.0, 0.05, 0.5, 0.777, 1.0]
    c = A.clonotypes(s, d)
    rows = [(column, share, float(x)) for column in ("frequency", "duplicate_count") for share, x in zip(shares, ranks.quantiles(scratch, c, column, shares), strict=True)]
    scratch.close()
    return s.createDataFrame(rows, "field string, share double, value double")
