"""Operators against plain versions, known values and their own identities."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from immunoframe.operators import association as assoc
from immunoframe.operators import dynamics, enrichment, kmer_space, neighbours, recombination, sampling, signature, singlecell
from immunoframe.operators.rarefaction import Spectrum
from immunoframe.plans import toy
from immunoframe.streaming import arrivals


def spectrum_of(counts):
    return Spectrum(*np.unique(counts, return_counts=True))


def test_rarefaction_identities():
    counts = np.array([46, 22, 17, 15, 15, 9, 8, 6, 6, 4, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1])
    s = spectrum_of(counts)
    assert (s.n, s.s, s.f1, s.f2) == (168, 26, 12, 4)
    assert s.asymptotic(0) == pytest.approx(26 + 167 / 168 * 144 / 8) and s.asymptotic(2) == pytest.approx(168 * 167 / sum(c * (c - 1) for c in counts))
    for q in (0, 1, 2, 3):
        assert s.at(168, q) == pytest.approx(s.observed(q)) and s.at(1, q) == pytest.approx(1.0)
        if q < 2:
            assert s.rarefied(50, q) < s.observed(q) < s.at(300, q) < s.asymptotic(q) + 1e-9
    for c in (0.3, 0.8, 0.95):
        assert s.coverage(s.size_at(c)) == pytest.approx(c)
    assert s.size_at(s.coverage()) == 168 and s.size_at(1.0) == float("inf")
    rng = np.random.default_rng(1)
    reads = np.repeat(np.arange(26), counts)
    seen = [len(set(rng.choice(reads, 40, replace=False))) for _ in range(4000)]
    assert np.mean(seen) == pytest.approx(s.rarefied(40, 0), rel=0.01)
    again = s.resampled(200, 3)
    assert all(x.n == 168 for x in again) and abs(np.mean([x.s for x in again]) - 26) < 3


def near(a, b, subs, ins, dels, total):
    """Fewest edits within a scope, by trying all."""
    best = {(0, 0, 0, 0, 0)}
    found, seen = None, set()
    while best:
        i, j, s, p, q = state = best.pop()
        if state in seen or s > subs or p > ins or q > dels or s + p + q > total:
            continue
        seen.add(state)
        if i == len(a) and j == len(b):
            found = s + p + q if found is None else min(found, s + p + q)
            continue
        if i < len(a) and j < len(b):
            best.add((i + 1, j + 1, s + (a[i] != b[j]), p, q))
        if j < len(b):
            best.add((i, j + 1, s, p + 1, q))
        if i < len(a):
            best.add((i + 1, j, s, p, q + 1))
    return found


@pytest.mark.parametrize("scope", ["0,0,0,0", "1,0,0,1", "2,0,0,2", "1,1,1,1", "2,1,1,2", "0,2,0,2", "3,0,0,3"])
def test_near_pairs(spark, scope):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("AB") for _ in range(rng.randint(4, 8)))
    x, y = [word() for _ in range(40)], [word() for _ in range(40)]
    frame = lambda w: spark.createDataFrame([(s,) for s in w] + [(None,)], "junction_aa string")
    got = {(r.seq_a, r.seq_b): r.distance for r in neighbours.near_pairs(frame(x), frame(y), scope=scope).collect()}
    want = {(a, b): d for a in set(x) for b in set(y) if (d := near(a, b, *map(int, scope.split(",")))) is not None}
    assert got == want


def test_substitutions_with_a_common_start(spark):
    """Thousands of sequences that begin alike: pairs are those of brute force, and rare pieces keep candidates few."""
    rng = random.Random(2)
    rows = [(i, "TGTGCCAGCAGTTTA" + "".join(rng.choice("ACGT") for _ in range(15)), 1) for i in range(300)]
    rows += [(1000 + i, s[:20] + "A" + s[21:], 1) for i, s, _ in rows[:50]] + [(2000 + i, s[:1] + "C" + s[2:18] + "C" + s[19:], 1) for i, s, _ in rows[50:90]]
    got = {(r.id_a, r.id_b): r.m for r in neighbours.substitution_pairs(spark.createDataFrame(rows, "id long, seq string, n long"), 2, []).collect()}
    off = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert got == {(i, j): d for i, a, _ in rows for j, b, _ in rows if i != j and 0 < (d := off(a, b)) <= 2}


def test_downsample_is_fair(spark):
    """Reads of clonotypes come in proportion to their counts, over parts as well as within them."""
    rows = [("s", i, 1 + i % 5) for i in range(400)] + [("small", 1000, 3)]
    df = spark.createDataFrame(rows, "sample_id string, ord long, duplicate_count long").withColumn("frequency", F.lit(0.0))
    kept = np.zeros(400)
    for seed in range(6):
        got = sampling.downsample(df, 300, seed=seed, part=50).collect()
        assert sum(r.duplicate_count for r in got if r.sample_id == "s") == 300 and [r.duplicate_count for r in got if r.sample_id == "small"] == [3]
        for r in got:
            if r.sample_id == "s":
                assert r.duplicate_count <= 1 + r.ord % 5
                kept[r.ord] += r.duplicate_count
    share = [kept[np.arange(400) % 5 == k].sum() / kept.sum() for k in range(5)]
    assert share == pytest.approx([(k + 1) / 15 for k in range(5)], abs=0.03)
    assert sorted(sampling.downsample(df, 300, part=50).collect()) == sorted(sampling.downsample(df.repartition(3), 300, part=50).collect())


def test_distributions():
    assert dynamics.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825) and dynamics.student_sf(2.0, 10) == pytest.approx(0.07338803477)
    assert dynamics.beta_cdf(dynamics._beta_quantile(0.025, 11, 91), 11, 91) == pytest.approx(0.025)


def test_poisson_tail(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (3, 1.0), (2, 50.0), (60, 50.0)], "k long, m double").withColumn("p", enrichment.poisson_tail("k", "m"))
    assert [r.p for r in df.collect()] == pytest.approx([1.0, 0.0, 1 - 2.5 * math.exp(-1), 1 - 51 * math.exp(-50), sum(math.exp(k * math.log(50) - 50 - math.lgamma(k + 1)) for k in range(60, 300))])


@pytest.mark.parametrize("alternative", ["greater", "less"])
def test_permutations_against_plain_counts(spark, monkeypatch, alternative):
    """Features of one sample, of some, and of all of them, which are added up in parts."""
    import hashlib

    monkeypatch.setattr(assoc, "TOGETHER", 4)
    samples = [f"s{i}" for i in range(23)]
    positive = {x: i % 3 == 0 for i, x in enumerate(samples)}
    held = {"all": samples, "one": samples[:1], "some": samples[::3] + samples[1:3], "none": ["unlabelled"]}
    design = spark.createDataFrame([(x, "cmv", p) for x, p in positive.items()], "sample_id string, level string, positive boolean")
    rows = [(x, f) for f, xs in held.items() for x in xs] * 2
    got = {r.f: (r.a, r.p_value) for r in assoc.permutation_p(spark.createDataFrame(rows, "sample_id string, f string"), design, ("f",), n_perm=51, seed=3, alternative=alternative).collect()}
    m, want = sum(positive.values()), {}
    marked = [set(sorted(samples, key=lambda x: (hashlib.md5(f"3:{i}:cmv:{x}".encode()).hexdigest(), x))[:m]) for i in range(51)]
    for f, xs in held.items():
        a = sum(positive.get(x, False) for x in xs)
        counts = [len(marks.intersection(xs)) for marks in marked]
        want[f] = (a, (1 + sum(c >= a if alternative == "greater" else c <= a for c in counts)) / 52)
    want.pop("none")
    assert {f: (a, pytest.approx(p)) for f, (a, p) in want.items()} == got


def test_bayes_and_permutation(spark):
    t = spark.createDataFrame([(8, 1, 2, 9), (5, 5, 5, 5)], "a long, b long, c long, d long")
    cells = [F.col(c) for c in "abcd"]
    p = [r.p for r in t.select(assoc.bayes_logodds(*cells)["p_or_gt1"].alias("p")).collect()]
    assert p[1] == pytest.approx(0.5) and 0.99 < p[0] < 1
    held = [(f"s{i}", "x") for i in range(10)] + [(f"s{i}", "y") for i in range(0, 20, 2)]
    design = spark.createDataFrame([(f"s{i}", "all", i < 10) for i in range(20)], "sample_id string, level string, positive boolean")
    got = {r.f: r.p_value for r in assoc.permutation_p(spark.createDataFrame(held, "sample_id string, f string"), design, ("f",), n_perm=400).collect()}
    assert got["x"] == pytest.approx(1 / 401) and got["y"] > 0.3


def test_effective_size(spark):
    """Two samples of 5,000 cells from one community, each cell read ten times: the size is that of the cells."""
    rng = np.random.default_rng(3)
    p = rng.pareto(1.2, 3000)
    p /= p.sum()
    frame = lambda: spark.createDataFrame(pd.DataFrame({"junction_aa": [f"C{i}" for i in range(3000)], "v_call": "V", "j_call": "J", "duplicate_count": rng.multinomial(5000, p) * 10}).query("duplicate_count > 0"))
    a, b = frame(), frame()
    assert 2500 < dynamics.estimate_neff(a, b) < 10_000
    calls = {r.dynamics: r.n for r in dynamics.test_pair(a, b).groupBy("dynamics").agg(F.count("*").alias("n")).collect()}
    assert calls.get("expanded", 0) + calls.get("contracted", 0) < 10 and calls["persistent"] > 50


def test_generation_follows_probability(spark):
    drawn = recombination.generate(spark, toy.VDJ, 20_000, seed=5)
    counts = drawn.groupBy("junction_nt").agg(F.count("*").alias("n"))
    top = recombination.pgen_nt(counts.orderBy(F.desc("n")).limit(40), toy.VDJ).collect()
    assert all(abs(r.n / 20_000 - r.pgen) < 5 * np.sqrt(r.pgen / 20_000) for r in top)
    assert recombination.check_model(toy.VDJ) == [] and drawn.count() == 20_000
    with pytest.raises(Exception, match="neither an allele"):
        recombination.pgen_nt(counts.withColumn("v", F.lit("V9")), toy.VDJ, v="v").collect()


def test_model_text(tmp_path):
    """A model in the common text form, its realisations out of order."""
    (tmp_path / "model_params.txt").write_text("\n".join([
        "@Event_list", "#GeneChoice;V_gene;Undefined_side;7;v_choice", "%V2*01;AATGCA;1", "%V1*01;CCTGTGCC;0", "#GeneChoice;J_gene;Undefined_side;6;j_choice", "%J1*01;TTTCAA;0",
        "#Deletion;V_gene;Three_prime;5;v_3_del", "%1;2", "%-1;0", "%0;1", "#Deletion;J_gene;Five_prime;5;j_5_del", "%0;0", "%1;1", "#Insertion;VJ_gene;Undefined_side;4;vj_ins", "%0;0", "%1;1", "#DinucMarkov;VJ_gene;Undefined_side;3;vj_dinucl",
        "%A;0", "@Edges", "@ErrorRate", "#SingleErrorRate", "0.01",
    ]))
    (tmp_path / "model_marginals.txt").write_text("\n".join([
        "@v_choice", "$Dim[2]", "#", "%0.25,0.75", "@j_choice", "$Dim[2,1]", "#[v_choice,0]", "%1", "#[v_choice,1]", "%1", "@v_3_del", "$Dim[2,3]", "#[v_choice,0]", "%0.2,0.3,0.5", "#[v_choice,1]", "%0.6,0.3,0.1",
        "@j_5_del", "$Dim[1,2]", "#[j_choice,0]", "%0.9,0.1", "@vj_ins", "$Dim[2]", "#", "%0.7,0.3", "@vj_dinucl", "$Dim[16]", "#", "%" + ",".join(["0.25"] * 16),
    ]))
    for s, rows in (("V", ["V1*01,2,F", "V2*01,2,P"]), ("J", ["J1*01,0,F"])):
        (tmp_path / f"{s}_gene_CDR3_anchors.csv").write_text("\n".join(["gene,anchor_index,function", *rows]))
    m = recombination.read_model(str(tmp_path))
    assert [s.name for s in m.v] == ["V1*01", "V2*01"] and m.v[0].cut == "TGTGCCG" and m.v[1].cut == "TGCAT" and m.j[0].cut == "TTT" and list(m.p_v) == [0.25, 0.75]
    # V1 whole with its palindromic base and J whole; V1 less that base, the insert G, J whole; V1 whole, the insert T, J less one base.
    assert recombination.pgen_of(m, "TGTGCCGTTT", False) == pytest.approx(0.25 * (0.2 * 0.7 * 0.9 + 0.3 * 0.3 * 0.25 * 0.9 + 0.2 * 0.3 * 0.25 * 0.1))
    assert [s.name for s in recombination.read_model(str(tmp_path), ("F",)).v] == ["V1*01"]


def test_saved_models(spark, tmp_path):
    for name, m in (("vj", toy.VJ), ("vdj", toy.VDJ)):
        recombination.save_model(spark, m, str(tmp_path / name))
        back = recombination.load_model(spark, str(tmp_path / name))
        assert all(recombination.pgen_of(back, t, False) == pytest.approx(recombination.pgen_of(m, t, False)) for t in ("TGTGCCTTTC", "TGTGCGGATTTC", "TGCAGGTTC"))


def test_kmer_space(spark, tmp_path):
    """The basis spans what a plain decomposition gives, and a saved space gives the same values."""
    rng = random.Random(1)
    rows = [(f"s{i % 6}", f"V{i % 2}", "CASS" + "".join(rng.choice("ADKFG") for _ in range(6)) + "QYFF", 1 / 50) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id string, v_call string, junction_aa string, frequency double")
    space = kmer_space.fit_kmer_space(df, pattern="x.x", min_df=0.0, max_df=1.0, components=3)
    x = space.weighted(df).toPandas().pivot_table(index="sample_id", columns="at", values="x", fill_value=0.0).to_numpy()
    left, sizes, right = np.linalg.svd(x, full_matrices=False)
    got = space.transform(df).where("component >= 0").toPandas().pivot_table(index="sample_id", columns="component", values="value").to_numpy()
    assert np.abs(got) == pytest.approx(np.abs(left[:, :3] * sizes[:3]), abs=1e-6)
    kmer_space.save_kmer_space(space, str(tmp_path / "space"))
    again = kmer_space.load_kmer_space(spark, str(tmp_path / "space")).transform(df).orderBy("sample_id", "component").toPandas()
    assert again.value.to_numpy() == pytest.approx(space.transform(df).orderBy("sample_id", "component").toPandas().value.to_numpy())
    with pytest.raises(ValueError, match="both ends"):
        kmer_space.pattern_of(".xx")


def test_cluster_scores_and_singletons(spark):
    df = spark.createDataFrame([(0, 5), (1, None), (2, 5), (3, None)], "ord long, c long")
    got = {r.ord: r.c for r in singlecell.assign_singleton_ids(df, "c").collect()}
    assert got == {0: 5, 1: -1, 2: 5, 3: -2}
    same = singlecell.cluster_eval(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "label_true string, label_pred long")).first()
    assert all(x == pytest.approx(1.0) for x in same)
    one = singlecell.cluster_eval(spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "label_true string, label_pred long")).first()
    assert one.purity == pytest.approx(2 / 3) and one.normalized_purity == pytest.approx(0.0) and one.homogeneity == pytest.approx(0.0, abs=1e-12) and one.q_measure == pytest.approx(0.0, abs=1e-12)


def test_signature_layout(spark):
    names = signature.columns("full")
    assert len(set(names)) == len(names) and set(signature.columns("core")) <= set(names) and signature.describe(spark).count() == len(signature.columns())
    with pytest.raises(ValueError, match="needs the number"):
        signature.apply("logit", F.lit(0.5))


def test_arrivals(spark, tmp_path):
    """Files that arrive after the first run are added to the profile."""
    rows = lambda s: spark.createDataFrame([(s, "TRBV1*01", None, "TRBJ1", None, "CF", "TGT", 2, 0.5), (s, "TRBV2", None, "TRBJ1", None, "CW", "TGG", 3, 0.5)], arrivals.STREAM_SCHEMA)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for n, s in enumerate(("a", "b")):
        rows(s).coalesce(1).write.mode("append").parquet(folder)
        arrivals.keep(arrivals.running_usage(arrivals.arrivals(spark, folder)), f"usage_{n}", f"{state}{n}").awaitTermination()
    got = {(r.sample_id, r.v_call): r.weight for r in spark.table("usage_1").collect()}
    assert got == {("a", "TRBV1"): 2, ("a", "TRBV2"): 3, ("b", "TRBV1"): 2, ("b", "TRBV2"): 3}


def test_model_enrichment_reads_clonotypes_once(spark, tmp_path):
    rows = [("S1", "V1*01", "J1", "CAF", f"N{i}", 2) for i in range(3)] + [("S1", "V1", "J1", "CSF", "N", 5), ("S1", "V1", "J1", "CWW", "N", 2), ("S1", "V1", "J1", "CAF", "few", 1), ("S2", "V1", "J1", "CAF", "N", 2)]
    spark.createDataFrame(rows, "sample_id string, v_call string, j_call string, junction_aa string, junction_nt string, duplicate_count long").write.parquet(f"{tmp_path}/c")
    balls = spark.createDataFrame([(s, "V1", "J1", 0.01) for s in ("CAF", "CSF", "CWW")], "junction_aa string, v_call string, j_call string, pgen_ball double")
    out = enrichment.alice(spark.read.parquet(f"{tmp_path}/c"), balls, min_degree=2)
    assert {(r.sample_id, r.junction_aa, r.duplicate_count, r.n_neighbors, r.n_group) for r in out.collect()} == {("S1", "CAF", 6, 4, 5), ("S1", "CSF", 5, 4, 5)}
    assert not [f for f in out.inputFiles() if f.startswith(f"file://{tmp_path}/")]


def test_poisson_tail_near_large_means(spark):
    """Against sums of all terms; terms far below the mean are not computed."""
    cases = [(n, float(m)) for m in (1, 70, 1000, 40000) for n in (1, m // 2, m - int(m**0.5), m, m + 1, m + 3 * int(m**0.5))]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k long, m double").withColumn("p", enrichment.poisson_tail("k", "m")).orderBy("i").collect()
    for r in got:
        whole = 1 - math.fsum(math.exp(i * math.log(r.m) - r.m - math.lgamma(i + 1)) for i in range(r.k))
        assert abs(r.p - whole) < 1e-9, (r, whole)
