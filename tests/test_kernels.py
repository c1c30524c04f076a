"""Kernels with residue penalties and gaps, against all pairs."""

import itertools
import math
import random

import pytest

from immunoframe.operators.kernels import penalised_pairs, penalties_from_scales, penalties_from_scores, read_scores, residue_diversity, residue_overlap

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def plain(x, y, penalties, gap_open, gap_extend, prior, anchor):
    worst = max(penalties.values())
    cost = lambda a, b: 0.0 if a == b else penalties.get((a, b), worst)
    if len(x) < len(y):
        x, y = y, x
    d, n = len(x) - len(y), len(y)
    if not d:
        return sum(map(cost, x, y))
    return min(sum(map(cost, x[:p] + x[p + d :], y)) + prior * abs(p - anchor * n) for p in range(n + 1)) + gap_open + (d - 1) * gap_extend


def junctions(seed, n=60):
    rng = random.Random(seed)
    out = {"", "C", "CASSXF", "CASSJF", None}
    drawn = random.Random(0)
    roots = ["".join(drawn.choices(LETTERS, k=drawn.randrange(8, 13))) for _ in range(8)]
    for _ in range(n):
        s = list(rng.choice(roots))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s))
            s[at] = rng.choice(next((g for g in ("ILVMF", "DENQ", "KRH", "STAG") if s[at] in g), LETTERS))
        if rng.random() < 0.5:
            p, d = rng.randrange(len(s)), rng.randrange(1, 3)
            s[p : p + d] = []
        out.add("".join(s))
    return sorted(out, key=str)


@pytest.mark.parametrize("most,gap_open,gap_extend,placement", [(4.0, 3.0, 1.0, "central"), (6.0, 2.0, 2.0, "frame"), (5.0, 99.0, 1.0, "none"), (5.0, 1.0, 1.5, "none")])
def test_pairs_are_those_of_all_pairs(spark, most, gap_open, gap_extend, placement):
    penalties = penalties_from_scales()
    x, y = junctions(1), junctions(2) + junctions(1)[:20]
    a, b = (spark.createDataFrame([(s, "other") for s in v], "junction_aa string, penalty string") for v in (x, y))
    got = penalised_pairs(a, b, penalties=penalties, most=most, gap_open=gap_open, gap_extend=gap_extend, placement=placement).collect()
    prior, anchor = (0.0, 0.0) if placement == "none" else (0.5, 0.5 if placement == "central" else 0.0)
    every = {(s, t): plain(s, t, penalties, gap_open, gap_extend, prior, anchor) for s, t in itertools.product(set(x) - {None}, set(y) - {None})}
    want = {k: v for k, v in every.items() if v <= most}
    assert {(r.seq_a, r.seq_b): r.penalty for r in got} == pytest.approx(want) and len(got) == len(want)
    assert sum(s != t for s, t in want) > 20


def test_overlap_lies_within_its_bounds(spark):
    """The sums of the near pairs are exact, and those of all pairs lie within the bounds; an empty sample is like nothing."""
    penalties, rng = penalties_from_scales(), random.Random(5)
    x, y = ({s: rng.random() for s in junctions(i, 30) if s} for i in (1, 2))
    a, b = (spark.createDataFrame(list(v.items()), "junction_aa string, frequency double") for v in (x, y))

    def product(p, q, most):
        cells = ((u * v, plain(s, t, penalties, 3.0, 1.0, 0.5, 0.5)) for s, u in p.items() for t, v in q.items())
        return sum(w * math.exp(-c / 2) for w, c in cells if c <= most)

    near, full = (product(x, y, m) / math.sqrt(product(x, x, m) * product(y, y, m)) for m in (4.0, math.inf))
    got = residue_overlap(a, b).first()
    assert got.similarity == pytest.approx(near) and got.low <= full <= got.high and got.low < got.similarity < got.high
    assert tuple(residue_overlap(a, b.limit(0)).first()) == (0.0, 0.0, 0.0)
    assert residue_overlap(a, a, metric="morisita").first().similarity == pytest.approx(1.0)


def test_diversity_counts_alike_junctions_once(spark):
    one = [("s", "CASSIF", 0.5), ("s", "CASSVF", 0.5), ("t", "CASSIF", 0.5), ("t", "CWWWDF", 0.5), ("t", None, 0.3)]
    got = {(r.sample_id, r.order_q): r.diversity for r in residue_diversity(spark.createDataFrame(one, "sample_id string, junction_aa string, frequency double")).collect()}
    z = 0.5 + 0.5 * math.exp(-penalties_from_scales()["I", "V"] / 2)
    assert all(got["s", o] == pytest.approx(1 / z) and got["t", o] == pytest.approx(2.0) for o in (0, 1, 2))


def test_scores_are_read_as_penalties(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# note\n   A  B\nA  4 -1\nB -1  6\n")
    assert penalties_from_scores(read_scores(spark, str(tmp_path / "m.txt"))) == {("A", "A"): 0, ("A", "B"): 12, ("B", "A"): 12, ("B", "B"): 0}
