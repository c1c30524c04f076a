"""Operators on pairs that came last (spelling variants, hard negatives, heavy-light join), against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from immunoframe.llm.heavy_light import LIMIT, boundary, least_heavy, light_keys, ngram_join, part_keys, subset_keys
from immunoframe.llm.spelling import RUN, Shard, group_variants, one_edit, word_counts
from immunoframe.llm.va_file import bounds, cells, hard_negatives

WORDS = "word string, n long, near string, size long"


def brute_variants(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return rows


def test_one_edit():
    assert one_edit("abc", "abd") and one_edit("abc", "ab") and one_edit("bc", "abc") and one_edit("", "a") and one_edit("aab", "aaab")
    assert not one_edit("abc", "abc") and not one_edit("abc", "acb") and not one_edit("abcd", "ab") and not one_edit("ab", "ba")


def test_halves_find_all_near_words():
    rng = random.Random(5)
    words = list({"".join(rng.choice("abé\n") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    for size in {len(w) for w in words}:
        held = [w for w in words if len(w) == size]
        shard = Shard(held)
        for asked in ([w for w in words if len(w) == size + d] for d in (-1, 0, 1)):
            want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(held) if one_edit(a, b)}
            assert not asked or set(shard.near(asked)) == want


def test_variants_against_brute_force(spark, monkeypatch):
    """Chains of forms, ties, very long words, words of one letter, a half that most words share, and several shards and blocks."""
    from immunoframe.llm import spelling

    monkeypatch.setattr(spelling, "SHARD", 60)
    monkeypatch.setattr(spelling, "BLOCK", 90)
    rng = random.Random(8)
    words = {"common" + "".join(rng.choice("xyz") for _ in range(rng.randint(1, 6))) for _ in range(150)} | {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)}
    counts = {w: rng.choice([1, 2, 5, 10, 60, 1000, 20000]) for w in sorted(words)}
    counts |= {"spelling": 50000, "speling": 600, "spelin": 20, "spelins": 2, "é" * 3000: 7, "é" * 2999: 80, "é" * 1500 + "x" + "é" * 1499: 3}
    rows = [(w, n, "c", 1) for w, n in counts.items()] + [(None, 5, None, None), ("", 3, "", 0)]
    got = group_variants(spark.createDataFrame(rows, WORDS)).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == brute_variants(counts)


def test_variants_odd_rows(spark):
    """Repeated words add up; no words give no rows; a ratio that allows circles is refused."""
    got = group_variants(spark.createDataFrame([("aaaa", 2, "", 1), ("aaaa", 3, "", 1), ("aaab", 50, "", 1)], WORDS)).collect()
    assert {tuple(r) for r in got} == {("aaaa", "aaab", "aaab", 5, 1, 50), ("aaab", None, "aaab", 50, 1, None)}
    assert group_variants(spark.createDataFrame([], WORDS)).collect() == []
    with pytest.raises(ValueError):
        group_variants(spark.createDataFrame([], WORDS), ratio=1)


def test_word_counts(spark):
    import regex

    texts = ["Éclair ÉCLAIRS éclairs running RUNNING runs\trunning_x " * 9, None, "", "ab" * 4000 + " " + "ab" * 4000, "x÷y×zÀÿÖö naïveté"]
    rows = [(i, t, "r") for i, t in enumerate(texts)] + [(None, "nullid nullidentity nullidentity", "r")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string")
    want = Counter()
    for i, t, _ in rows:
        for run in regex.findall(RUN, t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 7
    assert {tuple(r) for r in word_counts(docs, typo_every=31).collect()} == {(w, n) for w, n in want.items() if n >= 2}


VECTORS = "vec_id long, label int, embedding array<float>, node long, ids string, a int"


def brute_negatives(rows, positives=5, negatives=10):
    held = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            held[i] = max(held.get(i, (label, [])), (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a, (label, v) in held.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in held.items() if i != a and len(w) == len(v)}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if held[i][0] == label][:positives]:
            fit = [i for i in ranked if held[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:negatives], 1)}
    return out


def negatives_of(spark, rows):
    df = spark.createDataFrame([(i, label, v, 0, "x", 1) for i, label, v in rows], VECTORS)
    return hard_negatives(df, F.col("vec_id") % 100 == 0).collect()


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    """Several blocks and parts, a third of the rows with one vector, ties, vectors of other lengths, rows that take no part."""
    from immunoframe.llm import va_file

    monkeypatch.setattr(va_file, "ROWS", 1000)
    monkeypatch.setattr(va_file, "ASKED", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[rng.random(900) < 0.33] = x[0]
    x[rng.random(900) < 0.1] = np.round(x[1] * 2) / 2
    rows = [(i, int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + 10 * i, i % 2, [float(i % 7), 1.0]) for i in range(60)] + [(5000, 1, [0.0] * 6), (5001, 1, [0.5] * 6), (6000, 9, [0.5] * 6)]
    rows += [(7000, None, [1.0] * 6), (7100, 1, None), (7200, 1, []), (7300, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (7400, 1, [math.nan] * 6), (7500, 1, [math.inf] * 6), (None, 1, [1.0] * 6)]
    rows += [(100, 0, [9.0] * 6), (100, 0, [9.0] * 6)]
    got = negatives_of(spark, rows)
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    """No rows, one row, and components whose products doubles don't hold."""
    assert negatives_of(spark, []) == [] and negatives_of(spark, [(0, 1, [1.0])]) == []
    rng = np.random.default_rng(6)
    rows = [(50 * i, i % 2, [float(np.float32(c)) for c in rng.normal(size=3) * 3e6]) for i in range(40)]
    assert {tuple(r) for r in negatives_of(spark, rows)} == brute_negatives(rows)
    rows = [(0, 1, [3e30, 1.0]), (1, 1, [3e30, 2.0]), (2, 2, [-3e30, 1.0]), (3, 2, [1.0, 1.0])]
    assert {tuple(r)[:4] for r in negatives_of(spark, rows)} <= {(0, 1, 1, 3)}


def test_approximations_bound_scores():
    rng = np.random.default_rng(2)
    x, q = np.floor(rng.normal(size=(700, 9)) * 300), np.floor(rng.normal(size=(20, 9)) * 300)
    codes, low, high = cells(x)
    below, above = bounds(q, codes, low, high)
    exact = q @ x.T
    assert (below <= exact).all() and (exact <= above).all() and codes.max() == 63
    table = np.minimum(q[:, None] * low, q[:, None] * high)  # anchor, cell, dimension: the lookup tables themselves
    assert np.allclose(below, table[:, codes, np.arange(9)].sum(axis=2))
    codes, low, high = cells(x[:3])
    assert (low[codes, np.arange(9)] == x[:3]).all() and (high[codes, np.arange(9)] == x[:3]).all()


JOINED = "doc_id long, text string, n long, key string, kid int"


def brute_join(rows, percent=90):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, frozenset(tuple(words[a : a + 3]) for a in range(max(len(words) - 2, min(len(words), 1))))))
    root = list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        (i, s), (j, t) = sets[a], sets[b]
        if None not in (i, j) and s and t and 100 * len(s & t) >= percent * len(s | t):
            root[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[top(a)] = min(i, least.get(top(a), i)) if i is not None else None
    return sorted(((i, len(s), least[top(a)]) for a, (i, s) in enumerate(sets)), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, how = rng.randrange(len(words)), rng.random()
        if how < 0.4:
            words[at] = f"new{rng.randrange(10**6)}"
        elif how < 0.7:
            del words[-1]
        else:
            words.append(f"more{rng.randrange(10**6)}")
    return words


def test_join_against_brute_force(spark):
    """Sets of 1 to 400 elements near the threshold, a passage that many share, a group that most rows belong to, and odd rows."""
    rng = random.Random(12)
    texts = []
    for size in [*range(1, 48), 56, 57, 75, 76, 95, 120, 200, 400]:
        words = [f"w{rng.randrange(10**6)}" for _ in range(size + 2)]
        texts += [" ".join(edited(rng, words, e)) for e in (0, 0, 1, 1, 2, 3) if e < size]
        texts.append(" ".join(["passage"] * 2 + [f"p{i}" for i in range(30)] + words[:20]))
    hot = [f"h{i}" for i in range(150)]
    texts += [" ".join(edited(rng, hot, rng.randint(1, 4))) for _ in range(120)] + [" ".join(hot)] * 20
    texts += ["", None, " \t\n", "one", "ONE", "two words", "Two  Words", "a a a a a a", "a a a"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, "one"), (None, None), (7, "seven of nine and ten"), (7, "seven of nine and ten"), (7, "another text of seven")]
    got = ngram_join(spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], JOINED)).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


def test_join_odd_tables(spark):
    assert ngram_join(spark.createDataFrame([], JOINED)).collect() == []
    assert [tuple(r) for r in ngram_join(spark.createDataFrame([(5, None, 1, "k", 2)], JOINED)).collect()] == [(5, 0, 5)]
    long = " ".join(f"w{i % 30011}" for i in range(120_000))
    got = ngram_join(spark.createDataFrame([(2, long, 1, "k", 2), (1, long + " end", 1, "k", 2)], JOINED)).collect()
    assert sorted(map(tuple, got)) == [(1, 30012, 1), (2, 30011, 1)]


def test_light_and_heavy_keys_meet():
    """Similar sets share a subset key with opposite sides or a part key, whatever the boundary."""
    rng = np.random.default_rng(9)
    for _ in range(3000):
        n, x = int(rng.integers(1, 60)), int(rng.integers(0, 26))
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        t = np.unique(np.concatenate([s[rng.permutation(n)[: n - int(rng.integers(0, 1 + n // 15))]], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 15))).astype(np.uint64)]))
        both, union = len(np.intersect1d(s, t)), len(np.union1d(s, t))
        if both == union or 100 * both < 90 * union:
            continue
        if max(len(s), len(t)) <= x:
            sides = [dict(zip(*(a.tolist() for a in subset_keys(e, 90, x)), strict=True)) for e in (s, t)]
            assert any({sides[0][key], sides[1][key]} in ({0, 1}, {2}) for key in sides[0].keys() & sides[1].keys())
        else:
            assert min(len(s), len(t)) >= least_heavy(x, 90)
            assert len(np.intersect1d(*(part_keys(e, 90) for e in (s, t))))


def test_boundary_by_cost():
    few, many = boundary({12: 100, 40: 100}, 90), boundary({12: 100}, 90)
    assert 12 <= few < 40 and many >= 12 and light_keys(40, 90, 40) > 10_000
