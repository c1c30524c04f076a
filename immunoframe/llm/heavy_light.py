"""Exact Jaccard join of word n-gram sets, light sets and heavy sets apart.

Equal sets are one class. A class of at most ``x`` elements is light, a larger one heavy; ``x`` is the boundary at which the estimated
cost of both sides, over the sizes of all classes, is least (:func:`boundary`).

* Light: two sets of sizes n and m are similar exactly if they share a subset of ``ceil(t (n + m) / (1 + t))`` elements, so each set enumerates its subsets of
  that size for every size of a light partner. Sets under one subset are linked through the least of them, never pair by pair.
* Heavy (with the light sets that can be a heavy one's partner): a set is cut by hash into one part more than the elements in which two similar sets of its size may differ,
  so two similar sets have an equal part; sets with no equal part drop out. The others go to inverted lists: each scans the lists of its rarest elements, as many
  as one of which it must share, by size, place and the components found so far (:meth:`_Join.by_prefixes`, which also splits long lists).

Pairs that the lists propose are bounded by a bitmap of element parities (sets differ in at least as many elements as their bitmaps do in bits) and then
compared on full sets. No step is approximate; links are lost only if 64-bit hashes collide.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .setsketch import SALTS, _Join, _verify, set_key
from .textkernels import C1, C2, C3, C4, mix64, shingle_sets, slices

#: Sets of more elements are always heavy; bits of a bitmap.
LIMIT, BITS = 64, 2048
#: Cost of a heavy set besides its keys, in keys: reading its text again and its place in the lists.
HEAVY = 40


def overlap(n: int, m: int, percent: int) -> int:
    """The least number of common elements of similar sets of sizes ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int, most: int) -> list[int]:
    """Sizes of sets that can be similar to one of size ``n`` but not equal, up to ``most``."""
    return [m for m in range(-(-percent * n // 100), min(most, 100 * n // percent) + 1) if overlap(n, m, percent) <= min(n, m) and not (n == m == overlap(n, m, percent))]


@lru_cache(65536)
def levels(percent: int, n: int) -> tuple[tuple[int, int], ...]:
    """The schemes of a set of size ``n``: number, and parts. Scheme i is for pairs whose smaller set is of level i."""
    out, level, low = [], 0, 1
    while True:
        high = 100 * low // percent
        parts = (high + 100 * high // percent) * (100 - percent) // (100 + percent) + 1
        out = [*out[-1:], (level, parts)]
        if n <= high:
            return tuple(out)
        level, low = level + 1, high + 1


def least_heavy(x: int, percent: int) -> int:
    """The least size of a set that can be similar to a set of more than ``x`` elements."""
    return -(-percent * (x + 1) // 100)


def light_keys(n: int, percent: int, x: int) -> int:
    return sum(math.comb(n, n - overlap(n, m, percent)) for m in partners(n, percent, x))


def boundary(counts: dict[int, int], percent: int) -> int:
    """The size up to which sets are light, from the number of sets of each size up to ``LIMIT``."""

    def cost(x: int) -> int:
        heavy = sum(c * (HEAVY + sum(p for _, p in levels(percent, n))) for n, c in counts.items() if n >= least_heavy(x, percent))
        return heavy + sum(c * light_keys(n, percent, x) for n, c in counts.items() if n <= x)

    return min(range(LIMIT + 1), key=cost)


def parities(elements: np.ndarray) -> bytes:
    return np.packbits(np.bincount((elements >> np.uint64(64 - 11)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def part_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """A key for each part of each scheme of a set."""
    if not len(elements):
        return elements
    out, dealt, values = [], mix64(elements ^ C4), mix64(elements + C3)
    for level, parts in levels(percent, len(elements)):
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, (dealt % np.uint64(parts)).astype(np.int64), values)
        out.append(mix64(sums * C1 + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(level << 32))))
    return np.concatenate(out)


@lru_cache
def _left_out(n: int, d: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), d)), np.int64).reshape(math.comb(n, d), d)


def subset_keys(elements: np.ndarray, percent: int, x: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the subsets that a light set must share with a similar one, and the set's side: 0 smaller, 1 larger, 2 of equal size."""
    n, values = len(elements), mix64(elements + C2)
    keys, sides = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
    for m in partners(n, percent, x):
        rest = _left_out(n, n - overlap(n, m, percent))
        sums = values.sum(dtype=np.uint64) - values[rest].sum(axis=1, dtype=np.uint64)
        keys.append(mix64(sums * C1 + mix64(np.array([min(n, m) << 32 | max(n, m)], np.uint64))))
        sides.append(np.full(len(rest), 2 if n == m else int(n > m), np.int8))
    return np.concatenate(keys), np.concatenate(sides)


def _describe(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text):
                sets = list(shingle_sets(text.slice(a, b - a), k))
                keys = [set_key(s) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in keys], pa.int64())]
                columns += [pa.array([parities(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) if len(s) <= LIMIT else None for s in sets], pa.list_(pa.int64()))]
                parts = [part_keys(s, percent) for s in sets]
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", "n", "key", "kid", "sketch", "few", "parts"])

    return run


def _subsets(percent: int, x: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for key, few in zip(keys, batch.column("few").to_pylist(), strict=True):
                subsets, sides = subset_keys(np.array(few, np.int64).view(np.uint64), percent, x)
                if len(subsets):
                    yield pa.RecordBatch.from_arrays([pa.array(subsets.view(np.int64)), pa.array(sides), pa.array([key] * len(subsets), pa.binary())], ["subset", "side", "key"])

    return run


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the largest similarity that their bitmaps and sizes allow."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            b = batch.slice(at, 4096)
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sketch_a", "sketch_c"))
            n, m = (b.column(c).to_numpy().astype(float) for c in ("n_a", "n_c"))
            off = np.maximum(np.bitwise_count(x ^ y).sum(axis=1), np.abs(n - m))
            hi = np.clip((n + m - off) / (n + m + off) + 1e-12, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("c"), pa.array(np.zeros(len(n))), pa.array(hi)], ["a", "c", "lo", "hi"])


class _Exact(_Join):
    """The join whose bounds are certain: bitmaps from above, and the full sets."""

    def compare(self, pairs: DataFrame) -> None:
        cut, percent = self.scratch.cut, self.percent
        pairs = pairs.select(F.greatest("a", "c").alias("a"), F.least("a", "c").alias("c")).where("a != c").distinct()
        if self.bounds is not None:
            pairs = pairs.join(self.bounds.select("a", "c"), ["a", "c"], "left_anti")
        half = cut(pairs.join(self.named("a", "n", "sketch"), "a"))
        bounds = cut(half.join(self.named("c", "n", "sketch"), "c").mapInArrow(_difference, "a binary, c binary, lo double, hi double"))
        self.scratch.drop(half)
        hopeful = bounds.where(f"hi >= {percent / 100}").select("a", "c")
        if self.labels is not None:  # pairs of one component need no look
            for x in "ac":
                hopeful = hopeful.join(self.labels.select(F.col("node").alias(x), F.col("root").alias("root_" + x)), x, "left")
            hopeful = hopeful.where("root_a is null or root_c is null or root_a != root_c").select("a", "c")
        hopeful = cut(hopeful)
        salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt")
        members = hopeful.select(F.col("a").alias("x"), "c", salt, F.lit(True).alias("member"))
        centres = hopeful.select("c", salt).distinct().select(F.col("c").alias("x"), "c", "salt", F.lit(False).alias("member"))
        texts = self.texts(members.unionByName(centres), "x").select("x", "c", "salt", "member", "text")
        ordered = texts.repartition("c", "salt").sortWithinPartitions("c", "salt", "member")
        exact = cut(ordered.mapInArrow(_verify(self.k, percent), "a binary, c binary, j double, linked boolean").dropDuplicates(["a", "c"]))
        bounds = bounds.join(exact.select("a", "c", "j"), ["a", "c"], "left").select("a", "c", F.coalesce("j", "lo").alias("lo"), F.coalesce("j", "hi").alias("hi"))
        found = exact.where("linked").select("a", F.col("c").alias("b"))
        self.bounds = cut(bounds if self.bounds is None else self.bounds.unionByName(bounds))
        if self.labels is None or not found.isEmpty():
            self.links = cut(found if self.links is None else self.links.unionByName(found))
            self.labels = connected_components(self.scratch, self.links)


def _light_pairs(scratch: Scratch, classes: DataFrame, percent: int, x: int) -> DataFrame:
    """Pairs ``a``, ``c`` of light classes that share a subset of the size that makes them similar: each with the least of the other side."""
    subsets = scratch.cut(classes.where(f"n <= {x} and n > 0").select("key", "few").mapInArrow(_subsets(percent, x), "subset long, side byte, key binary"))
    least = subsets.groupBy("subset").agg(F.min(F.when(F.col("side") != 1, F.col("key"))).alias("small"), F.min(F.when(F.col("side") == 1, F.col("key"))).alias("large"), F.count("*").alias("size"))
    shared = scratch.cut(least.where("size > 1").drop("size"))
    other = F.when(F.col("side") == 0, F.col("large")).otherwise(F.col("small"))
    return scratch.cut(subsets.join(shared, "subset").select(F.col("key").alias("a"), other.alias("c")).where("a != c").distinct())


def ngram_join(docs: DataFrame, *, k: int = 3, percent: int = 90, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``.

    Documents are linked if their sets of ``k``-word shingles (A-Z lower-cased; fewer words: the whole sequence as one) have
    ``100 * intersection >= percent * union``; a component's id is its smallest ``doc_id``. Null or wordless text has the empty set and is linked
    with nothing. A null ``doc_id`` is linked with nothing and has a null component. Rows that repeat a ``doc_id`` are several
    texts under one id, each with its own set. Extra columns are ignored; no rows give no rows; texts of any length are read whole.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = scratch.cut(docs.mapInArrow(_describe(k, percent), "doc_id long, n long, key binary, kid long, sketch binary, few array<long>, parts array<long>"))
    classes = table.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "kid", "sketch", "few")).alias("m"))
    classes = scratch.cut(classes.select("key", "m.*"))
    counts = {r["n"]: r["size"] for r in classes.where(f"n <= {LIMIT}").groupBy("n").agg(F.count("*").alias("size")).collect()}
    x = boundary(counts, percent)
    light = _light_pairs(scratch, classes, percent, x)

    parts = table.where(f"n >= {least_heavy(x, percent)} and doc_id is not null").select(F.explode("parts").alias("part"), "kid")
    shared = scratch.cut(parts.groupBy("part").agg(F.min("kid").alias("a"), F.max("kid").alias("b")).where("a != b").select("part"))
    kids = scratch.cut(parts.join(shared.hint("shuffle_hash"), "part").select("kid").distinct())
    heavy = scratch.cut(classes.join(kids, "kid", "left_semi").select("key"))

    join = _Exact(scratch, docs, classes.select("key", "doc_id", "n", "sketch"), k, percent)
    join.read_candidates(heavy.unionByName(light.select(F.col("a").alias("key"))).unionByName(light.select(F.col("c").alias("key"))).distinct())
    if heavy.isEmpty():
        join.compare(light)
    else:
        join.by_prefixes(heavy, light)

    own = classes.select("key", F.col("doc_id").alias("rep"))
    rooted = scratch.cut(own.join(join.labels.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root")))
    least_ids = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    named = table.select("doc_id", "n", "key").join(scratch.cut(rooted.join(least_ids, "root").select("key", "least")), "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return scratch.result(named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")))
