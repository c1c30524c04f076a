"""Layout and grouping of samples, and joins of keys that very many rows share, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from immunoframe.operators import association, cluster, overlap
from immunoframe.operators.pairs import pairs_between, pairs_within
from immunoframe.sources.scratch import Scratch


@pytest.fixture
def scratch(spark):
    held = Scratch(spark, "cluster")
    yield held
    held.close()


def table(spark, names, far):
    return spark.createDataFrame([(a, b, float(far[i][j])) for i, a in enumerate(names) for j, b in enumerate(names)], "sample_a string, sample_b string, distance double")


def scaled(far, k):
    """Classical scaling of a whole matrix."""
    n = len(far)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-centre @ (np.array(far) ** 2) @ centre / 2)
    return values[::-1][:k], vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))


def test_layout_of_points(spark, scratch):
    """Points of a plane come back up to turns, with a point that stands twice."""
    rng = np.random.default_rng(1)
    at = np.vstack([rng.normal(size=(30, 2)) * [5, 1], [[0.3, 0.4]] * 2])
    far = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    names = [f"s{i:02}" for i in range(32)]
    got = {r["sample"]: (r.mds1, r.mds2) for r in cluster.layout(scratch, table(spark, names, far)).collect()}
    back = np.array([got[x] for x in names])
    assert np.allclose(np.hypot(*(back[:, None] - back[None]).transpose(2, 0, 1)), far, atol=1e-7)
    assert np.allclose(back.mean(axis=0), 0, atol=1e-9)


def test_layout_of_other_distances(spark, scratch):
    """Distances of no space at all, with large negative values: the leading axes are those of the whole matrix."""
    rng = np.random.default_rng(2)
    n = 40
    far = rng.uniform(1, 9, (n, n))
    far = np.triu(far, 1) + np.triu(far, 1).T
    far[:20, 20:] += 4
    far[20:, :20] += 4
    names = [f"s{i:02}" for i in range(n)]
    got = {r["sample"]: [r.mds1, r.mds2, r.mds3] for r in cluster.layout(scratch, table(spark, names, far), 3).collect()}
    values, want = scaled(far, 3)
    back = np.array([got[x] for x in names])
    assert np.allclose((back**2).sum(axis=0), values, rtol=1e-6)
    for i in range(3):
        assert min(np.abs(back[:, i] - s * want[:, i]).max() for s in (1, -1)) < 1e-4
        assert back[np.abs(back[:, i]).argmax(), i] > 0


def test_layout_of_odd_tables(spark, scratch):
    assert cluster.layout(scratch, table(spark, [], [])).count() == 0
    assert [tuple(r) for r in cluster.layout(scratch, table(spark, ["a"], [[0]])).collect()] == [("a", 0.0, 0.0)]
    two = {r["sample"]: (r.mds1, r.mds2) for r in cluster.layout(scratch, table(spark, ["a", "b"], [[0, 3], [3, 0]])).collect()}
    assert two["b"] == pytest.approx((1.5, 0)) and two["a"] == pytest.approx((-1.5, 0))
    with pytest.raises(ValueError):
        cluster.cluster_samples(scratch, table(spark, ["a"], [[0]]), "other")


def merged(names, far):
    """Average linkage one merge at a time."""
    units = [[round(x * cluster.UNIT) for x in row] for row in far]
    parts = {x: [i] for i, x in enumerate(names)}
    out = []
    while len(parts) > 1:
        mean = lambda a, b: sum(units[i][j] for i in parts[a] for j in parts[b]) // (len(parts[a]) * len(parts[b]))
        h, a, b = min((mean(a, b), a, b) for a, b in itertools.combinations(sorted(parts), 2))
        out.append((a, b, h / cluster.UNIT, len(parts[a]), len(parts[b])))
        parts[a] += parts.pop(b)
    return out


@pytest.mark.parametrize("small", [1, 6, 256])
def test_linkage(spark, scratch, small):
    """With many ties, and however many of the merges are made together."""
    rng = random.Random(4)
    names = [f"s{i:02}" for i in range(17)]
    far = [[0.0] * 17 for _ in names]
    for i, j in itertools.combinations(range(17), 2):
        far[i][j] = far[j][i] = rng.choice([1.0, 2.0, 2.5, rng.random() * 3])
    want = merged(names, far)
    got = sorted(map(tuple, cluster.linkage(scratch, table(spark, names, far), small=small).collect()), key=lambda r: (r[2], r[0], r[1]))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    for k in (1, 4, 30) if small == 6 else (5,):
        parts, order = {x: [x] for x in names}, {x: [x] for x in names}
        for i, (a, b, *_) in enumerate(want):
            order[a] += order.pop(b)
            if i < 17 - k:
                parts[a] += parts.pop(b)
        leaves = order[names[0]]
        first = sorted(parts, key=lambda x: min(map(leaves.index, parts[x])))
        label = {x: first.index(p) + 1 for p in parts for x in parts[p]}
        rows = cluster.groups(scratch, table(spark, names, far), k, small=small).collect()
        assert {r["sample"]: (r.cluster, r.leaf_order) for r in rows} == {x: (label[x], leaves.index(x)) for x in names}


def test_groups_of_odd_tables(spark, scratch):
    assert cluster.groups(scratch, table(spark, [], []), 3).count() == 0
    assert [tuple(r) for r in cluster.groups(scratch, table(spark, ["a"], [[0]]), 3).collect()] == [("a", 1, 0)]
    same = cluster.cluster_samples(scratch, table(spark, ["a", "b", "c"], [[0] * 3] * 3), "hclust", 2, spark.createDataFrame([("a", 5)], "sample string, age int"))
    assert {tuple(r) for r in same.collect()} == {("a", 1, 0, 5), ("b", 1, 1, None), ("c", 2, 2, None)}


def test_pairs_in_blocks(spark):
    """A key of 60 rows in blocks of 7, single rows, and null keys."""
    rng = random.Random(5)
    rows = [("hot", f"w{i:02}", i) for i in range(60)] + [(f"k{rng.randrange(9)}", f"w{i:02}", -i) for i in range(30)] + [(None, "w1", 0), (None, "w2", 0), ("one", "w1", 3)]
    df = spark.createDataFrame(rows, "key string, who string, n long")
    got = sorted(map(tuple, pairs_within(df, ["key"], "who", ["n"], tile=7).select("key", "who_a", "who_b", "n_a", "n_b").collect()))
    assert got == sorted((k, a, b, x, y) for (k, a, x), (c, b, y) in itertools.permutations(rows, 2) if k == c and k is not None and a < b)
    df = df.withColumn("_blocks", F.when(F.col("key") == "hot", 9).otherwise(1))
    left, right = df.select("key", F.col("who").alias("a"), "_blocks"), df.where("n % 2 = 0").select("key", F.col("who").alias("b"), "_blocks")
    got = sorted(map(tuple, pairs_between(left, right, ["key"], "a", "b").select("key", "a", "b").collect()))
    assert got == sorted((k, a, b) for k, a, _ in rows for c, b, n in rows if k == c and k is not None and n % 2 == 0)


def test_shared_clonotypes_in_blocks(spark):
    """A clonotype of all samples: overlap and co-occurrence are the same in blocks of two as in one."""
    rng = random.Random(6)
    rows = [(f"S{s:02}", f"{c}V{v}", "J1", "CASS" + x + "F", rng.randrange(1, 9)) for s in range(12) for c in ("TRA", "TRB") for v, x in enumerate("ADEG") if x == "A" or rng.random() < 0.6]
    df = spark.createDataFrame(rows, "sample_id string, v_call string, j_call string, junction_aa string, duplicate_count long")
    rounded = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert rounded(overlap.cohort_overlap(df, tile=2)) == rounded(overlap.cohort_overlap(df))
    blocks, whole = (rounded(association.cooccurrence(df, key=("v_call",), tile=t)) for t in (2, 1000))
    assert blocks == whole and blocks


def test_fuzzy_and_wide_distances(spark):
    """Fuzzy distances are those of each pair alone; the wide form has the same numbers."""
    rows = [("a", "CASSA", 3), ("a", "CASSD", 1), ("b", "CASSE", 2), ("b", "CQQQF", 6), ("c", "CQQQG", 5), ("c", "CWWWF", 5), ("d", "CYYYY", 1)]
    df = spark.createDataFrame(rows, "sample_id string, junction_aa string, duplicate_count long")
    want = {("a", "b"): math.sqrt(1.0 * 0.25), ("b", "c"): math.sqrt(0.75 * 0.5)}
    long = {(r.sample_a, r.sample_b): r.distance for r in overlap.pairwise_distances(df, scope="1,0,0,1").collect()}
    assert long == pytest.approx({(x, y): 0.0 if x == y else -math.log10(want.get((min(x, y), max(x, y)), 0.0) + 1e-9) for x in "abcd" for y in "abcd"})
    wide = overlap.pairwise_distances(df, scope="1,0,0,1", form="matrix")
    assert wide.columns == ["sample", *"abcd"] and {(r["sample"], y): r[y] for r in wide.collect() for y in "abcd"} == pytest.approx(long)
    with pytest.raises(ValueError):
        overlap.pairwise_distances(df, "R", scope="1,0,0,1")
