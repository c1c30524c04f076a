"""Recombination scenarios as tables, against enumeration and the plain kernel."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from immunoframe.operators import recombination
from immunoframe.operators.recombination import BASES, Model, Segment
from immunoframe.operators.scenarios import best_scenarios, expected_counts, infer, scenario_sums
from immunoframe.plans import toy


def inserts(model, k):
    for size, p in enumerate(model.ins[k]):
        for t in itertools.product(range(4), repeat=size):
            order, w = t[::-1] if k else t, p
            for i, b in enumerate(order):
                w *= model.first[k][b] if not i else model.step[k][order[i - 1], b]
            yield "".join(BASES[b] for b in t), w


def space(model):
    """All recombinations: sequence, V end, D start and end, J start, and probability."""
    first, second = list(inserts(model, 0)), list(inserts(model, 1)) if model.d else []
    for (a, v), (b, j) in itertools.product(enumerate(model.v), enumerate(model.j)):
        p_j = model.p_j[a, b] if model.p_j.ndim == 2 else model.p_j[b]
        for (i, x), (k, y) in itertools.product(enumerate(v.trim), enumerate(j.trim)):
            left, right, w = v.cut[: len(v.cut) - i], j.cut[k:], model.p_v[a] * p_j * x * y
            if not model.d:
                for s, p in first:
                    yield left + s + right, (v.name, None, j.name, len(left), None, None, len(left + s)), w * p
                continue
            for c, d in enumerate(model.d):
                for (m, n), z in np.ndenumerate(d.trim):
                    middle = d.cut[m : len(d.cut) - n]
                    for (s, p), (t, q) in itertools.product(first, second):
                        at = len(left + s)
                        yield left + s + middle + t + right, (v.name, d.name, j.name, len(left), at, at + len(middle), at + len(middle + t)), w * model.p_d[b, c] * z * p * q


#: J doesn't depend on V.
APART = Model(toy.VJ.v, toy.VJ.j, toy.VJ.p_v, np.array([0.35, 0.65]), toy.VJ.ins, toy.VJ.step)


@pytest.mark.parametrize("model", [toy.VJ, APART, toy.VDJ], ids=["vj", "apart", "vdj"])
def test_sums_and_best_scenarios(spark, model):
    """Sums and maxima equal those of all recombinations; the scenario that is named has the probability that is returned."""
    total, ways = {}, {}
    for s, what, p in space(model):
        total[s] = total.get(s, 0.0) + p
        ways.setdefault(s, {}).setdefault(what, 0.0)
        ways[s][what] = max(ways[s][what], p)
    some = sorted(total)[:: max(1, len(total) // 300)]
    odd = ["", "A", "NNNN", "TGTGNTTTC", "ACGT" * 500, None, some[0].lower()]
    df = spark.createDataFrame([(s, i, "x") for i, s in enumerate([*some, *odd, some[0], some[0]])], "junction_nt string, n int, piece string")
    got = scenario_sums(df, model).collect()
    assert len(got) == len(some) + len(odd) + 2
    for r in got:
        assert r.pgen is None if r.junction_nt is None else r.pgen == pytest.approx(total.get(r.junction_nt.upper(), 0.0), rel=1e-9)
    best = best_scenarios(df, model).collect()
    assert {r.s for r in best} == {*(s for s in some if total[s] > 0), some[0].lower()}
    for r in best:
        s = r.s.upper()
        assert r.p == pytest.approx(max(ways[s].values()), rel=1e-9)
        assert ways[s][r.v_call, r.d_call, r.j_call, r.v_end, r.d_start, r.d_end, r.j_start] == pytest.approx(r.p, rel=1e-9)


def test_sums_by_calls_agree_with_the_plain_kernel(spark):
    df = recombination.generate(spark, toy.VDJ, 400, seed=9).limit(60).cache()
    for r in scenario_sums(df, toy.VDJ, v="v_call", j="j_call").collect():
        assert r.pgen == pytest.approx(recombination.pgen_of(toy.VDJ, r.junction_nt, False, r.v_call, r.j_call), rel=1e-9)
    with pytest.raises(Exception, match="neither an allele"):
        scenario_sums(df.withColumn("v_call", F.lit("V9")), toy.VDJ, v="v_call").collect()


def flat(model):
    even = lambda segments: [Segment(s.name, s.cut, np.full_like(s.trim, 1 / s.trim.size)) for s in segments]
    return Model(even(model.v), even(model.j), np.full_like(model.p_v, 0.5), np.full_like(model.p_j, 0.5), [np.full_like(x, 1 / len(x)) for x in model.ins], [np.full((4, 4), 0.25) for _ in model.step], even(model.d), None if model.p_d is None else np.full_like(model.p_d, 0.5))


def test_inference(spark, tmp_path):
    """The likelihood never falls, the parameters that drew the junctions come back, and an interrupted run goes on where it stopped."""
    df = recombination.generate(spark, toy.VJ, 4000, seed=2).select("junction_nt").cache()
    whole, history = infer(df, flat(toy.VJ), rounds=6, tolerance=0)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False)) and len(history) == 6
    assert np.abs(whole.p_v - toy.VJ.p_v).max() < 0.03 and np.abs(whole.p_j - toy.VJ.p_j).max() < 0.06 and np.abs(whole.ins[0] - toy.VJ.ins[0]).max() < 0.03
    path = str(tmp_path / "rounds")
    infer(df, flat(toy.VJ), rounds=3, tolerance=0, path=path)
    (tmp_path / "rounds" / "3").mkdir()  # what a lost driver left of the fourth round
    again, resumed = infer(df, flat(toy.VJ), rounds=6, tolerance=0, path=path)
    assert resumed == pytest.approx(history, abs=1e-12) and again.p_v == pytest.approx(whole.p_v, abs=1e-12) and again.step[0] == pytest.approx(whole.step[0], abs=1e-12)


def test_inference_odd_tables(spark):
    """Junctions that no scenario gives leave the model alone; copies of a row count as often as they occur."""
    none = spark.createDataFrame([(None,), ("",), ("NNN",), ("CCCCCCCC",), ("TGTGCCCCCCCCCCCCTTTC",)], "junction_nt string")
    model, history = infer(none, toy.VDJ, rounds=3)
    assert history == [] and model is toy.VDJ
    rows = [("TGTGCTTTC",)] * 3 + [("TGCATTTC",), ("tgcatttc",)]
    got = {(r.kind, r.piece): r.x for r in expected_counts(spark.createDataFrame(rows, "junction_nt string"), toy.VDJ).where("kind like 'len%' or kind = 'fit'").collect()}
    assert got["fit", "n"] == pytest.approx(5) and sum(x for (k, _), x in got.items() if k == "len1") == pytest.approx(5)
