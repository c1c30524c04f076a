"""Operators over a whole corpus, against plain versions."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from immunoframe.llm.components import connected_components
from immunoframe.llm.mih import nearest
from immunoframe.llm.mixing import mix, mixed_rows, targets
from immunoframe.llm.scratch import Scratch
from immunoframe.llm.setsketch import MISS, banding, merge, near_duplicates, registers, similarity_bounds
from immunoframe.llm.sharding import shard

from .test_text_operators import documents, odd_docs


def brute_components(rows, k=3, percent=85):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
        sets.append((i, s))
    top = {i: i for i, _ in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    held = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            held[x].append(n)
    seen = set()
    for at in held.values():
        for a in at:
            for b in at:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    (i, s), (j, t) = sets[a], sets[b]
                    if 100 * len(s & t) >= percent * len(s | t):
                        x, y = sorted((root(i), root(j)))
                        top[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def test_near_duplicates(spark, sf):
    docs, rows = documents(spark, sf)
    want = brute_components([(i, t) for i, t, _ in rows])
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_large_buckets(spark):
    """Hundreds of near copies, chains of edits and exact copies share buckets; links are those of brute force."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    rows, text = [], list(base)
    for i in range(260):
        if i % 4 == 0:
            text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(text)))
    rows += [(300 + i, " ".join(base)) for i in range(80)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark, "One two", "one  TWO", "one two three")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(0, 1, 0, True), (1, 1, 0, False), (2, 1, 2, True), (1000, 0, 1000, True), (1001, 0, 1001, True), (None, 1, None, True), (1002, 1, 1002, True), (1002, 1, 1002, True)], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_near_dedup_stage(spark, sf):
    """The pipeline's stage keeps what brute force keeps with five-word shingles at 0.8: on the table, and on pairs from 0.80 to 0.85 and large buckets."""
    from corpus_pipeline import near_dedup

    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for _ in range(30):  # 96 of 116 five-word shingles, 98 of 118 three-word ones
        text = fresh(100)
        rows += [" ".join(text), " ".join(text + fresh(20))]
    for n in (24, 25):  # 96 of 120 is a link, 96 of 121 isn't
        text = fresh(100)
        rows += [" ".join(text), " ".join(text + fresh(n))]
    base = fresh(150)
    for _ in range(90):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = fresh(1)[0]
        rows.append(" ".join(text))
    rows = [(100_000 + i, t) for i, t in enumerate(rows)]
    for given in (rows, [(i, t) for i, t, _ in documents(spark, sf)[1]]):
        want = {i for i, (_, root) in brute_components(given, 5, 80).items() if i == root}
        assert want != {i for i, (_, root) in brute_components(given).items() if i == root}
        assert {r.doc_id for r in near_dedup(spark, spark.createDataFrame(given, "doc_id long, text string"), "").collect()} == want


def test_pipeline_stages_go_by_rows(spark):
    """Null and repeated ids: a rejected row goes and takes no other row of its id with it; of equal rows one stays."""
    import corpus_pipeline as p

    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(1, a), (1, "too short"), (None, "short too"), (2, a + " x"), (None, a), (None, b), (None, b), (3, c), (3, c), (3, d), (4, d + " tail"), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s" if n % 2 else None, 0, "g") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, given string")
    kept = p.quality(spark, docs, "rows")
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns and left == sorted((x for x in rows if x[1] and len(x[1]) > 20), key=str)
    once = p.near_dedup(spark, kept, "rows")
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=str) == sorted([(1, a), (None, b), (3, c), (3, d)], key=str)
    docs = once
    for name, stage in p.STAGES[2:4]:
        docs = Scratch(spark, "t").cut(stage(spark, docs, "rows"))
        assert docs.columns == kept.columns and docs.schema["n_chars"].dataType.simpleString() == "int", name
    assert {r.text for r in docs.collect()} <= {a, b, c, d} and all(r.n_chars == len(r.text) for r in docs.collect())
    assert p.packing(spark, docs, "rows").count() == docs.count()
    empty = p.STAGES[-1][1](spark, p.secrets(spark, p.near_dedup(spark, p.quality(spark, kept.limit(0), "e"), "e"), "e"), "e")
    assert empty.collect() == []


def test_pipeline_against_plain_stages(spark, sf):
    """The whole pipeline on the table: what stays is what plain versions of the first two stages keep, mixed within bounds, and packed whole."""
    import corpus_pipeline as p
    from immunoframe.llm.quality_lines import quality_rules

    docs, rows = documents(spark, sf)
    good = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    once = {i for i, (_, root) in brute_components([(i, t) for i, t, _ in rows if i in good], 5, 80).items() if i == root}
    pieces = p.run(spark, sf).collect()
    taken = defaultdict(int)
    for r in pieces:
        taken[r.doc_id] += r.piece == 0
    assert set(taken) <= once and max(taken.values()) <= 3
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    of, size, got = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int)
    for i in once:
        size[of[i]] += words[i]
        got[of[i]] += taken[i] * words[i]
    want = brute_targets(dict(size))
    assert all(abs(got[s] - want[s]) <= max(words[i] for i in once if of[i] == s) for s in want)
    by = defaultdict(int)
    for r in pieces:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 4096


def test_bands_fit_the_threshold():
    assert banding(85) == (36, 7)
    for percent in range(5, 101):
        bands, rows = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= MISS * (1 + 1e-9) and bands * rows <= 280


def test_set_sketches():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[1000:]
    assert (merge(registers(a), registers(b)) == registers(x)).all()
    lo, mid, hi = similarity_bounds(registers(a)[None], registers(b)[None], np.array([2000.0]), np.array([2000.0]))
    assert lo[0] <= 1 / 3 <= hi[0] and abs(mid[0] - 1 / 3) < 0.12


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (2, 1), (7, 3)], "a long, b long")
    got = defaultdict(set)
    for r in connected_components(Scratch(spark, "t"), links).collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 7], [8, 9]]
    assert connected_components(Scratch(spark, "t"), links.limit(0)).collect() == []


def test_nearest(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in vectors.collect()]
    got = defaultdict(list)
    for r in nearest(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for i, v in rows:
        if i % 20 == 0:
            want = sorted(((-float(v @ w), j) for j, w in rows if j != i))[:20]
            mine = got[i]
            assert [x[0] for x in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda x: (-x[2], x[1]))
            hit += len({j for _, j in want} & {x[1] for x in mine})
            total += 20
    assert hit / total >= 0.9 and set(got) == {i for i, _ in rows if i % 20 == 0}


def test_nearest_at_size(spark):
    """20,000 vectors without structure, where the radius binds: recall, few pairs for a query, and a vector that a third of the rows repeat."""
    from immunoframe.llm import mih

    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 32))
    x[rng.random(len(x)) < 0.3] = x[7]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    seen, pairs = [], mih._Index.pairs

    def counted(self, asked, s, radius):
        out = pairs(self, asked, s, radius)
        seen.append((s, self.rows, radius, asked.count(), out.count()))
        return out

    mih._Index.pairs = counted
    try:
        got = nearest(df).toPandas()
    finally:
        mih._Index.pairs = pairs
    s, rows, radius, asked, found = seen[0]
    assert s < 8 and radius < mih.WHOLE // 2 and found < 0.05 * rows * asked
    lists = got.sort_values("rank").groupby("query_id").vec_id.apply(list)
    assert len(lists) == 1000 and lists.apply(len).eq(20).all()
    hit = total = 0
    for i in range(0, len(x), 400):
        score = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != i][:20]
        hit += len(set(order) & set(lists[i]))
        total += 20
    assert hit / total >= 0.9


def test_nearest_queries_unlike_the_rows(spark):
    """Clustered rows; a fifth of the queries are short vectors that lie in none of the clusters."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(100, 32))
    x = centres[rng.integers(0, 100, 3000)] + 0.15 * rng.normal(size=(3000, 32))
    odd = np.arange(0, 800, 20)
    x[odd] = 0.05 * rng.normal(size=(len(odd), 32))
    got = nearest(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")).toPandas()
    lists = got.sort_values("rank").groupby("query_id").vec_id.apply(list)
    assert len(lists) == 150 and lists.apply(len).eq(20).all()
    hits = {i: len(set([j for j in np.lexsort((np.arange(len(x)), -(x @ x[i]))) if j != i][:20]) & set(lists[i])) / 20 for i in range(0, len(x), 20)}
    assert np.mean(list(hits.values())) >= 0.9 and np.mean([hits[i] for i in odd]) >= 0.8


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (40, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_nearest_repeated_rows_and_lengths(spark):
    """A row repeated 50 times takes one place; vectors of another length have neighbours of their own."""
    rows = [(20, [1.0, 0.0])] + [(1, [0.9, 0.1])] * 50 + [(i, [0.5, i / 100]) for i in range(2, 15)] + [(40, [1.0, 0.0, 0.0]), (41, [0.0, 1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(20, 1), (20, 2), (20, 3), (20, 4), (20, 5), (40, 41)]


def test_shard(spark, sf):
    docs, rows = documents(spark, sf)
    got = shard(docs, shards=10).collect()
    text = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes"
        by[r.shard].append(r)
    most = max(r.size for r in got)
    share = sum(r.size for r in got) / 10
    for s in range(10):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s]))) and abs(sum(r.size for r in by[s]) - share) <= most


def test_shard_groups_and_odd_rows(spark):
    """A third of all rows are copies of one text: ranges are subdivided and shards stay even."""
    docs = odd_docs(spark, *["the same text again"] * 700, *(f"text {i}" for i in range(1400)))
    got = shard(docs).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == docs.count() and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) < 120
    assert shard(docs.limit(0)).collect() == []


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / w for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1}, {"a": 0, "b": 7}, {"a": 100, "b": 1, "c": 3, "d": 50, "é": 20, "Z": 9}])
def test_mix_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(Scratch(spark, "t"), df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark, sf):
    docs, rows = documents(spark, sf)
    got = mix(docs).collect()
    assert sorted(got) == sorted(mix(docs.repartition(3)).collect())  # reruns agree
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    total, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        total[of[r.doc_id]] += size[r.doc_id]
        taken[of[r.doc_id]] += r.taken
        most[of[r.doc_id]] = max(most[of[r.doc_id]], r.size)
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size <= 3 * r.size and len(r.shards) == r.copies
    want = brute_targets(dict(total))
    for r in got:
        assert r.source_size == total[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)


def test_mixed_rows(spark):
    docs = odd_docs(spark, *(f"a b c {i}" for i in range(40)))
    got = mixed_rows(docs)
    assert got.columns == docs.columns
    n = {r.doc_id: r.copies for r in mix(docs).collect()}
    assert got.count() == sum(mix(docs).select("copies").toPandas().copies) and n[1000] is not None
    assert mix(docs.limit(0)).collect() == [] and mixed_rows(docs.limit(0)).collect() == []
