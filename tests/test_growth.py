"""Steps whose work must follow the input: what is cut once, combined before it is joined, or left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from immunoframe.operators import batch, dynamics, kmer_space, sampling, signature
from immunoframe.plans import adapter as A
from immunoframe.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clonotypes_sort_no_whole_sample(spark, sf):
    c = A.clonotypes(spark, sf)
    assert "Window" not in plan(c)
    by_sql = A._select(A.reads(spark, sf), "reads", A.CLONOTYPES)
    assert c.columns == by_sql.columns and c.exceptAll(by_sql).isEmpty() and by_sql.exceptAll(c).isEmpty()


def test_pooled_rows_are_not_copied_for_distinct_counts(spark, sf):
    assert "Expand" not in plan(QUERIES["pool_strict"](spark, sf))


@pytest.mark.parametrize("name", ["pairwise_distances", "pairwise_distances_fuzzy", "kmer_vocabulary", "expansion", "expansion_dispersion"])
def test_sums_by_coarse_keys_group_no_clonotypes(spark, sf, name, monkeypatch):
    asked = []
    monkeypatch.setattr(A, "clonotypes", lambda *of, **how: asked.append(of))
    QUERIES[name](spark, sf)
    assert not asked


def test_correction_pairs_junctions_and_counts_not_rows(spark, monkeypatch):
    seen, pairs = [], sampling.substitution_pairs
    monkeypatch.setattr(sampling, "substitution_pairs", lambda items, *of: seen.append(pairs(items, *of)) or seen[-1])
    rows = [("s", i, "ACGTACGTACGT", 1) for i in range(400)] + [("s", 400, "ACGTACGTACGA", 1000), ("s", 401, "NNN", 7)]
    df = spark.createDataFrame(rows, "sample_id string, ord long, junction_nt string, duplicate_count long").withColumn("frequency", F.lit(0.0))
    out = {r.ord: r.duplicate_count for r in sampling.correct(df).collect()}
    assert out == {400: 1400, 401: 7} and seen[0].count() == 2


def test_parts_that_give_no_reads_are_not_drawn(spark):
    df = spark.range(2000).selectExpr("'s' as sample_id", "id as ord", "5L as duplicate_count", "0e0 as frequency")
    drawn = sampling.downsample(df, 30, part=10)
    assert "(_quota" in plan(drawn) and drawn.agg(F.sum("duplicate_count")).first()[0] == 30


def test_chances_of_equal_shares_are_mirrored():
    for t, r in ((0, 5.0), (7, 0.3), (500, 5.0)):
        want = np.exp(dynamics._log_beta_binomial(np.arange(t + 1.0), np.full(t + 1, float(t)), r))
        assert dynamics._beta_binomial(t, r) == pytest.approx(want, rel=1e-10)
    p = dynamics._beta_binomial(1_000_001, 5.0)
    assert (p == p[::-1]).all() and p.sum() == pytest.approx(1.0, rel=1e-12)


def test_usage_and_signatures_read_their_rows_once(spark, sf):
    c = A.clonotypes(spark, sf)
    usage = batch.correct_vj_usage(c.withColumn("batch", F.col("sample_id")))
    assert usage.inputFiles() and all("vj-usage" in f for f in usage.inputFiles())
    made = signature.features(c, tier="core")
    assert made.inputFiles() and all("signature" in f for f in made.inputFiles())


def test_samples_without_known_kmers_keep_a_row(spark):
    rows = [("a", "TRBV1", "CASSAAFFCASSF"), ("b", "TRBV1", "CASSAAFFCASSF"), ("c", "TRBV9", "CASSWWWWWASSF")]
    df = spark.createDataFrame(rows, "sample_id string, v_call string, junction_aa string").withColumn("frequency", F.lit(1.0))
    space = kmer_space.fit_kmer_space(df, pattern="xx", min_df=0.5, max_df=0.9, components=1)
    got = {(r.sample_id, r.component): r.value for r in space.transform(df).collect()}
    assert got["c", -1] == 0.0 and ("c", 0) not in got and got["a", 0] == pytest.approx(1.0)
    none = kmer_space.fit_kmer_space(df, pattern="xx", min_df=0.99, max_df=0.995)
    assert {(r.sample_id, r.component): r.value for r in none.transform(df).collect()} == {("a", -1): 0.0, ("b", -1): 0.0, ("c", -1): 0.0}
