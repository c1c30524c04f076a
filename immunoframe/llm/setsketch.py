"""Near-duplicate documents by SetSketch registers.

1. Documents become sets of word shingles. Documents with equal sets are one class from here on, so a group
   of copies of any size costs one node.
2. Each class gets a SetSketch: by register, the smallest of exponentially distributed element values,
   truncated to the exponentially spaced levels ``floor(1 - log_b(x))``. Registers merge by their maximum and
   two sets agree in a register with about their Jaccard similarity.
3. Bands of register values give buckets. Buckets of at most ``SMALL`` members are compared pairwise. The
   joint likelihood of two sketches bounds their similarity from both sides, and only pairs that may reach
   the threshold are verified, on their full sets. Links become components.
4. Larger buckets are not expanded. For their members the exact prefix filter finds the pairs: of two similar
   sets, the larger one's ``n - ceil(t n) + 1`` rarest shingles meet the smaller one's
   ``n - ceil(2 t n / (1 + t)) + 1`` rarest. Where many sets share one of their rarest shingles, all are
   compared with one centre (a star), the set with the most common shingles, as it is likely to be what the
   others were copied from. Then members stay that are of another component, or that the triangle inequality
   of the Jaccard distance cannot separate from one, and more stars follow, of several centres. A member whose rarer shingles
   alone rule out every partner in the bucket leaves it. Rounds end when no unsettled pair is left, so nothing
   is capped.

The one chance of losing a link is that two similar sets share no bucket (at most ``MISS``, 1e-6, at any threshold, as
:func:`banding` sizes the bands for it) or that the likelihood bound is wrong (about 1e-5 at the threshold).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .textkernels import C1, C2, C3, mix64, shingle_sets, slices

#: Chance that two sets at the threshold share no bucket, at most; registers of a sketch that bands of several rows may take.
MISS, REGISTERS = 1e-6, 280
BASE, RATE, LEVELS = 1.001, 20.0, 65534
#: Buckets of at most so many unsettled members are finished pairwise.
SMALL = 24
#: Tasks that share the members of one centre.
SALTS = 64
#: Log-likelihood below the maximum at which a similarity counts as excluded (4.2 standard deviations).
DOUBT = 9.0


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band for a threshold: the longest bands that miss ``MISS`` at most and fit ``REGISTERS``."""
    fits = (1, 1)
    for rows in range(1, 17):
        share = (percent / 100) ** rows
        bands = 1 if share >= 1 else math.ceil(math.log(MISS) / math.log1p(-share))
        if rows == 1 or bands * rows <= REGISTERS:
            fits = (bands, rows)
    return fits


BANDS, ROWS = banding(85)


@lru_cache
def _draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.random.default_rng(20240229)
    return (pick.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None], pick.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def registers(elements: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` SetSketch registers of a set of 64-bit element hashes; all zero for the empty set."""
    if not len(elements):
        return np.zeros(size, np.uint16)
    mul, add = _draws(size)
    h = (elements >> np.uint64(32)).astype(np.uint32)
    least = None
    for at in range(0, len(h), 1024):
        part = (mul * h[None, at : at + 1024] + add).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def set_key(elements: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix64(elements * C1).sum(dtype=np.uint64), mix64(elements + C2).sum(dtype=np.uint64) ^ mix64(np.array([len(elements)], np.uint64) * C3)[0]]).tobytes()


def similarity_bounds(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, most likely and largest Jaccard similarity, from sketches and set sizes, by joint likelihood.

    A register of the first set is the larger one with probability ``p(u - v J)``, the smaller one with
    ``p(v - u J)``, where u and v are the shares of the sizes and ``p(x) = -log_b(1 - x (b - 1) / b)``.
    """
    more, less = (k1 > k2).sum(axis=1), (k1 < k2).sum(axis=1)
    u = (n1 / (n1 + n2))[:, None]
    v = 1.0 - u
    j = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: np.maximum(-np.log1p(-np.maximum(x, 0.0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1.0 - up - down, 1e-12)
    ll = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (k1.shape[1] - more - less)[:, None] * np.log(same)
    ok = ll >= ll.max(axis=1, keepdims=True) - DOUBT
    rows = np.arange(len(j))
    step = j[:, 1]
    return np.maximum(j[rows, ok.argmax(axis=1)] - step, 0), j[rows, ll.argmax(axis=1)], np.minimum(j[rows, j.shape[1] - 1 - ok[:, ::-1].argmax(axis=1)] + step, 1)


def _sketch(k: int, column: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(column)
            for a, b in slices(text):
                sizes, keys, sketches = [], [], []
                for s in shingle_sets(text.slice(a, b - a), k):
                    sizes.append(len(s))
                    keys.append(set_key(s))
                    sketches.append(registers(s, size).tobytes())
                given = [batch.column(c).slice(a, b - a) for c in ("doc_id", "of")]
                yield pa.RecordBatch.from_arrays([*given, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "of", "n", "key", "sketch"])

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            b = batch.slice(at, 4096)
            k1, k2 = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sketch_a", "sketch_c"))
            lo, _, hi = similarity_bounds(k1, k2, *(b.column(c).to_numpy().astype(float) for c in ("n_a", "n_c")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "c", "n_a", "n_c")), pa.array(lo), pa.array(hi)], ["a", "c", "n_a", "n_c", "lo", "hi"])


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            text, cs, xs, roles = batch.column("text"), batch.column("c").to_pylist(), batch.column("x").to_pylist(), batch.column("member").to_pylist()
            for a, b in slices(text):
                got = []
                for i, s in zip(range(a, b), shingle_sets(text.slice(a, b - a), k), strict=True):
                    if set_key(s) != xs[i]:  # another text of the same doc_id
                        continue
                    if not roles[i]:
                        centre, own = cs[i], s
                    elif centre == cs[i]:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        union = len(own) + len(s) - both
                        got.append((xs[i], cs[i], both / union, 100 * both >= percent * union))
                columns = zip(*got, strict=True) if got else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.float64(), pa.bool_()), strict=True)], ["a", "c", "j", "linked"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keys = batch.column("text"), batch.column("key").to_pylist()
            for a, b in slices(text):
                kept = [(keys[i], s) for i, s in zip(range(a, b), shingle_sets(text.slice(a, b - a), k), strict=True) if set_key(s) == keys[i]]
                if kept:
                    of = np.repeat(np.arange(len(kept)), [len(s) for _, s in kept])
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.binary()).take(pa.array(of)), pa.array(np.concatenate([s for _, s in kept]).view(np.int64))], ["key", "shingle"])

    return run


class _Join:
    """The classes, what is known of their pairs so far (``bounds``, ``links``), and the components."""

    def __init__(self, scratch: Scratch, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> None:
        self.scratch, self.docs, self.classes, self.k, self.percent = scratch, docs, classes, k, percent
        self.bounds: DataFrame | None = None
        self.candidates: DataFrame | None = None
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def named(self, of: str, *columns: str) -> DataFrame:
        return self.classes.select(F.col("key").alias(of), *(F.col(c).alias(f"{c}_{of}") for c in columns))

    def read_candidates(self, keys: DataFrame) -> None:
        """Fetches the texts of classes that may have partners, once; all later joins are with these."""
        ids = self.classes.join(keys, "key", "left_semi").select("key", "doc_id")
        self.candidates = self.scratch.cut(self.docs.join(ids.hint("merge"), "doc_id").select("key", "text"))

    def texts(self, wanted: DataFrame, of: str) -> DataFrame:
        """``wanted`` with the text of each class named in its column ``of``."""
        return wanted.join(self.candidates.withColumnRenamed("key", of).hint("merge"), of)

    def compare(self, pairs: DataFrame) -> None:
        """Bounds, verifies and links pairs ``a``, ``c`` that may repeat; known pairs and pairs of one component are left out."""
        cut, percent = self.scratch.cut, self.percent
        pairs = pairs.select(F.greatest("a", "c").alias("a"), F.least("a", "c").alias("c")).where("a != c").distinct()
        if self.bounds is not None:
            pairs = pairs.join(self.bounds.select("a", "c"), ["a", "c"], "left_anti")
        pairs = cut(pairs)
        half = cut(pairs.join(self.named("a", "n", "sketch"), "a"))
        fits = f"100 * least(n_a, n_c) >= {percent} * greatest(n_a, n_c)"
        bounds = cut(half.join(self.named("c", "n", "sketch"), "c").mapInArrow(_bounds, "a binary, c binary, n_a long, n_c long, lo double, hi double"))
        self.scratch.drop(half, pairs)
        hopeful = bounds.where(f"hi >= {percent / 100} and {fits}").select("a", "c")
        if self.labels is not None:
            for x in "ac":
                hopeful = hopeful.join(self.labels.select(F.col("node").alias(x), F.col("root").alias("root_" + x)), x, "left")
            hopeful = hopeful.where("root_a is null or root_c is null or root_a != root_c").select("a", "c")
        hopeful = cut(hopeful)
        salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt")
        wanted = hopeful.select(F.col("a").alias("x"), "c", salt, F.lit(True).alias("member"))
        wanted = wanted.unionByName(hopeful.select(F.col("c").alias("x"), "c", salt, F.lit(False).alias("member")).distinct())
        texts = self.texts(wanted, "x").select("x", "c", "salt", "member", "text")
        ordered = texts.repartition("c", "salt").sortWithinPartitions("c", "salt", "member")
        exact = cut(ordered.mapInArrow(_verify(self.k, percent), "a binary, c binary, j double, linked boolean").dropDuplicates(["a", "c"]))
        bounds = bounds.join(exact.select("a", "c", "j"), ["a", "c"], "left").select("a", "c", F.coalesce("j", "lo").alias("lo"), F.coalesce("j", "hi").alias("hi"))
        found = exact.where("linked").select("a", F.col("c").alias("b"))
        self.bounds = cut(bounds if self.bounds is None else self.bounds.unionByName(bounds))
        if self.labels is None or not found.isEmpty():
            self.links = cut(found if self.links is None else self.links.unionByName(found))
            self.labels = connected_components(self.scratch, self.links)

    def apart(self, members: DataFrame, of: str) -> DataFrame:
        """``members`` with ``apart``: whether ``key`` and the class in column ``of`` are in different components."""
        root = self.labels.select(F.col("node").alias("key"), "root")
        placed = members.drop("apart").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
        placed = placed.join(root.select(F.col("key").alias(of), F.col("root").alias("top")), of, "left")
        return placed.withColumn("apart", F.col("root") != F.coalesce("top", of)).drop("root", "top")

    def unsettled(self, star: DataFrame) -> DataFrame:
        """Of buckets whose members have all been compared with ``c``, those members that may still have a link to another component."""
        placed = self.apart(star.where("key != c"), "c")
        known = self.bounds.select(F.col("a").alias("x"), F.col("c").alias("y"), "lo", "hi")
        placed = placed.withColumn("x", F.greatest("key", "c")).withColumn("y", F.least("key", "c")).join(known, ["x", "y"], "left")
        placed = placed.withColumn("lo", F.coalesce("lo", F.lit(0.0))).withColumn("hi", F.coalesce("hi", F.lit(1.0))).drop("x", "y")
        placed = self.scratch.cut(placed.withColumnRenamed("c", "main"))
        far = self.scratch.cut(placed.where("apart").groupBy("bucket").agg(F.max("hi").alias("top_hi")))
        return placed.join(far, "bucket").where(f"apart or lo - top_hi <= {1 - self.percent / 100 + 1e-9}").drop("lo", "hi", "top_hi")

    def by_bands(self) -> tuple[DataFrame, DataFrame]:
        """The pairs within small buckets of equal bands, and the members of large buckets."""
        count, rows = banding(self.percent)
        width = 2 * rows
        bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.xxhash64(j, F.substring("sketch", j * width + 1, F.lit(width)))))
        members = self.classes.select("key", bands.alias("bucket"))
        sizes = self.scratch.cut(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
        shared = self.scratch.cut(members.join(sizes, "bucket"))
        self.read_candidates(shared.select("key").distinct())
        few, many = shared.where(f"size <= {SMALL}"), shared.where(f"size > {SMALL}")
        pairs = few.select(F.col("key").alias("a"), "bucket").join(few.select("bucket", F.col("key").alias("c")), "bucket").where("c < a").select("a", "c")
        return pairs, self.scratch.cut(many.select("key").distinct())

    def by_prefixes(self, keys: DataFrame, extra: DataFrame | None = None) -> None:
        """Compares all pairs of these classes that can be similar, and first also the pairs ``extra``."""
        cut, p = self.scratch.cut, self.percent
        shingles = cut(self.texts(keys, "key").select("key", "text").mapInArrow(_sets(self.k), "key binary, shingle long").distinct())
        df = cut(shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
        ranked = shingles.join(df, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
        ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("df", "shingle")))
        own = Window.partitionBy("key")
        sized = ranked.withColumn("score", F.avg(F.log2("df")).over(own)).withColumn("n", F.count("*").over(own)).where("df > 1")
        probe = sized.where(f"at <= n - (({p} * n + 99) div 100) + 1").withColumn("index", F.expr(f"at <= n - ((2 * {p} * n + {99 + p}) div {100 + p}) + 1"))
        active = cut(probe.select(F.col("shingle").alias("bucket"), "key", "n", "at", "index", "score", F.lit(True).alias("apart")))
        first = True
        while True:
            # With its first common shingle at ``at`` a set shares at most n - at + 1; the least partner that is left asks for more of some.
            least = active.groupBy("bucket").agg(F.min("n").alias("least"), F.count("*").alias("size")).where("size > 1").select("bucket", "least")
            partner = f"greatest(least, ({p} * n + 99) div 100)"
            alive = cut(active.join(cut(least), "bucket").where(f"{100 + p} * (n - at + 1) >= {p} * (n + {partner})").drop("least"))
            of = F.when(F.col("apart"), F.struct("index", "score", "key"))
            counts = (F.count_if("index").alias("indexed"), F.count_if("apart").alias("outside"), F.max(of).alias("top"))
            sizes = cut(alive.groupBy("bucket").agg(F.count("*").alias("size"), *counts).where("size > 1 and indexed > 0 and outside > 0"))
            # Few on one side: every pair of two components, in proportion to the other side.
            few = alive.join(sizes.where(f"indexed <= {SMALL} or outside <= {SMALL}").select("bucket"), "bucket")
            many = sizes.where(f"indexed > {SMALL} and outside > {SMALL}")
            if first:
                star = cut(alive.join(many.select("bucket", F.col("top.key").alias("c")), "bucket"))
            else:  # up to SMALL centres in each bucket
                outside = alive.where("apart").join(many.select("bucket"), "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SMALL)))
                centres = cut(outside.groupBy("bucket", "part").agg(F.max(F.struct("score", "key")).alias("top")).select("bucket", F.col("top.key").alias("c")))
                star = cut(alive.join(centres, "bucket"))
            left = few.select("bucket", "apart", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
            right = few.where("index").select("bucket", F.col("apart").alias("apart_c"), F.col("key").alias("c"), F.col("n").alias("n_c"), F.col("at").alias("at_c"))
            fits = f"a != c and n_c <= n_a and 100 * n_c >= {p} * n_a and {100 + p} * (1 + least(n_a - at_a, n_c - at_c)) >= {p} * (n_a + n_c)"
            pairs = left.where("apart").join(right, "bucket").where(fits).select("a", "c")
            pairs = pairs.unionByName(left.where("not apart").join(right.where("apart_c"), "bucket").where(fits).select("a", "c"))
            pairs = pairs.unionByName(star.select(F.col("key").alias("a"), "c"))
            self.compare(pairs if extra is None else pairs.unionByName(extra))
            if star.isEmpty():
                return
            if first:
                active = self.unsettled(star)
            else:
                done = centres.select("bucket", F.col("c").alias("key"))
                active = self.apart(alive.join(many.select("bucket"), "bucket").join(done, ["bucket", "key"], "left_anti"), "main")
            active, extra, first = cut(active), None, False


def text_key(text: Column) -> Column:
    """Two hashes of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(5), text).alias("b"))


def near_duplicates(docs: DataFrame, *, k: int = 3, percent: int = 85, text: str = "text", with_keys: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Documents are linked if their ``k``-word shingle sets have ``100 * intersection >= percent * union``.
    Null or wordless text has the empty set and is linked with nothing. A null ``doc_id`` is linked with
    nothing, has a null component and is kept. Rows that repeat a ``doc_id`` are one document if their texts
    agree, and otherwise several texts under one id. Extra columns are ignored; no rows give no rows. ``with_keys`` adds
    ``of``, :func:`text_key` of the row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = scratch.cut(docs.withColumn("of", text_key(F.col("text"))).mapInArrow(_sketch(k, "text", math.prod(banding(percent))), "doc_id long, of struct<a: long, b: long>, n long, key binary, sketch binary"))
    classes = scratch.cut(
        table.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m")).select("key", "m.*")
    )
    join = _Join(scratch, docs, classes, k, percent)
    pairs, many = join.by_bands()
    if many.isEmpty():
        join.compare(pairs)
    else:
        join.by_prefixes(many, pairs)
    named = table.select("doc_id", "of", "n", "key")
    reps = classes.select("key", F.col("doc_id").alias("rep"))
    rooted = scratch.cut(reps.join(join.labels.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root")))
    least = scratch.cut(rooted.groupBy("root").agg(F.min("rep").alias("least")))
    reps = scratch.cut(rooted.join(least, "root").select("key", F.col("least").alias("rep")))
    out = named.join(reps, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *(["of"] if with_keys else []))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
