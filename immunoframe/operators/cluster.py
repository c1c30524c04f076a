"""Layout and grouping of samples by their distances.

Distances are a long table ``sample_a, sample_b, distance`` with both orders of every pair, as
:func:`~immunoframe.operators.overlap.pairwise_distances` gives it. It is never brought to one place: the layout multiplies it by a few
columns at a time, the linkage merges all pairs of mutually nearest clusters in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Columns beyond the wanted ones that the layout multiplies with.
EXTRA = 6
#: Columns that the layout keeps, as a multiple of those that it multiplies; beyond, it goes on from the best ones.
KEPT = 6
#: Distances are compared in whole units, so that their sums are exact in any order.
UNIT = 10**12
#: Clusters whose remaining merges one task computes (a table of at most so many squared rows).
SMALL = 256


def _inner(table: DataFrame, columns: list[str]) -> np.ndarray:
    """Inner products of a constant and all components of the array columns, in this order: partitions add up their own, so the driver gets one small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            z = np.hstack([np.ones((len(batch), 1)), *(np.array(batch[c].tolist(), dtype=float).reshape(len(batch), -1) for c in columns)]) if len(batch) else None
            if z is not None:
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"at": range(total.size), "x": total.ravel()})

    cells = table.select(*columns).mapInPandas(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
    size = round(len(cells) ** 0.5)
    return cells["x"].to_numpy().reshape(size, size)


def _combined(table: DataFrame, columns: list[str], into: dict[str, np.ndarray]) -> DataFrame:
    """``sample`` and array columns: a constant and the components of ``columns``, times each matrix of ``into``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z = np.hstack([np.ones((len(batch), 1)), *(np.array(batch[c].tolist(), dtype=float).reshape(len(batch), -1) for c in columns)])
                yield pd.DataFrame({"sample": batch["sample"], **{c: list(z @ m) for c, m in into.items()}})

    kind = dict(table.dtypes)["sample"]
    return table.select("sample", *columns).mapInPandas(run, f"sample {kind}, " + ", ".join(f"{c} array<double>" for c in into))


def _apart(inner: np.ndarray, m: int) -> np.ndarray:
    """From inner products of (1, q, x): how they combine to columns of length 1 that stand upright on each other, the constant and the ``m`` columns of q."""
    off = np.linalg.solve(inner[: 1 + m, : 1 + m], inner[: 1 + m, 1 + m :])
    own = inner[1 + m :, 1 + m :] - inner[1 + m :, : 1 + m] @ off
    scale = 1 / np.sqrt(np.maximum(np.diag(own), 1e-300))
    size, turn = np.linalg.eigh(own * np.outer(scale, scale))
    kept = size > 1e-9 * size.max()
    turn = scale[:, None] * turn[:, kept] / np.sqrt(size[kept])
    return np.vstack([-off @ turn, turn])


def layout(scratch: Scratch, dist: DataFrame, n_components: int = 2, *, tolerance: float = 1e-7, rounds: int = 300) -> DataFrame:
    """``sample, mds1, mds2, ...``: classical scaling, the leading axes of the doubly centred squared distances.

    A block of columns is multiplied with the distances in each round (one join on the sample and one grouping); the best combinations of all
    columns kept so far give the axes, their residuals the next block, until these are below ``tolerance`` of the largest value. Centring is a
    shift of the columns, so the centred matrix is never written. Axes without a positive value are 0. The sign of an axis
    is such that its largest coordinate in size is positive (ties: the last sample's). One sample stands at 0; an empty table gives an empty one.
    A table that doesn't settle in ``rounds`` raises.
    """
    names = scratch.cut(dist.select(F.col("sample_a").alias("sample")).distinct())
    axes = [f"mds{i + 1}" for i in range(n_components)]
    squared = scratch.cut(dist.where("distance > 0").select(F.col("sample_a").alias("sample"), "sample_b", (F.col("distance") * F.col("distance")).alias("_d")))
    if squared.isEmpty():
        return names.select("sample", *(F.lit(0.0).alias(c) for c in axes))
    width = min(n_components + EXTRA, names.count() - 1)
    start = F.array(*(F.xxhash64("sample", F.lit(i)) / float(1 << 63) for i in range(width)))
    none = F.array().cast("array<double>")
    held, m = scratch.cut(names.select("sample", none.alias("q"), none.alias("w"), start.alias("x"))), 0
    written = held
    inner = _inner(held, ["q", "x"])
    for _ in range(rounds):
        # the next block x, and its products y with the distances
        into = np.insert(_apart(inner, m), [1 + m] * m, 0, axis=0)
        p = into.shape[1]
        same = np.eye(len(into))
        block = scratch.cut(_combined(held, ["q", "w", "x"], {"q": same[:, 1 : 1 + m], "w": same[:, 1 + m : 1 + 2 * m], "x": into}))
        products = squared.join(block.select(F.col("sample").alias("sample_b"), "x"), "sample_b").groupBy("sample").agg(*(F.sum(F.col("_d") * F.col("x")[i]).alias(f"_{i}") for i in range(p)))
        y = F.array(*(F.coalesce(F.col(f"_{i}") / -2, F.lit(0.0)) for i in range(p)))
        both = scratch.cut(block.join(products, "sample", "left").select("sample", "q", "w", "x", y.alias("y")))
        # the best combinations of q and x, and their residuals
        inner = _inner(both, ["q", "w", "x", "y"])
        of_q, of_w = [*range(1, 1 + m), *range(1 + 2 * m, 1 + 2 * m + p)], [*range(1 + m, 1 + 2 * m), *range(1 + 2 * m + p, 1 + 2 * m + 2 * p)]
        cross = inner[np.ix_(of_q, of_w)] - np.outer(inner[0, of_q], inner[0, of_w]) / inner[0, 0]
        values, vectors = np.linalg.eigh((cross + cross.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        m = m + p if m + p <= KEPT * width else 2 * width
        goal = min(width, len(values))
        to_q, to_w = np.zeros((len(inner), len(values))), np.zeros((len(inner), len(values)))
        to_q[of_q], to_w[of_w], to_w[0] = vectors, vectors, -(inner[0, of_w] / inner[0, 0]) @ vectors
        held = scratch.cut(_combined(both, ["q", "w", "x", "y"], {"q": to_q[:, :m], "w": to_w[:, :m], "x": to_w[:, :goal] - to_q[:, :goal] * values[:goal]}))
        scratch.drop(written, block, both)
        written = held
        inner = _inner(held, ["q", "x"])
        size = np.abs(values).max()
        far = np.sqrt(np.diag(inner)[1 + m :])
        if size == 0 or (far[:n_components] <= tolerance * size).all():
            break
        open_ = [int(i) for i in np.flatnonzero(far > 1e-10 * size)]  # the others have settled
        used = [*range(1 + m), *(1 + m + i for i in open_)]
        inner, held = inner[np.ix_(used, used)], held.withColumn("x", F.array(*(F.col("x")[i] for i in open_)))
    else:
        raise ValueError(f"the layout did not settle in {rounds} rounds")
    wanted = [i for i in range(min(n_components, goal)) if values[i] > size * 1e-12]
    at = held.select("sample", *((F.col("q")[i] * float(values[i]) ** 0.5 if i in wanted else F.lit(0.0)).alias(c) for i, c in enumerate(axes)))
    at = scratch.cut(at)
    signs = at.agg(*(F.signum(F.max_by(c, F.struct(F.round(F.abs(c), 9), "sample"))).alias(c) for c in axes)).first()
    return at.select("sample", *((F.col(c) * (signs[c] or 1.0)).alias(c) for c in axes))


def _merged_plainly(rows: pd.DataFrame) -> pd.DataFrame:
    """All merges of at most ``SMALL`` clusters, in order."""
    names = sorted(set(rows["a"]))
    at = {x: i for i, x in enumerate(names)}
    n = len(names)
    total, size = np.zeros((n, n), dtype=object), [1] * n
    for a, b, na, s in zip(rows["a"], rows["b"], rows["na"], rows["s"], strict=True):
        total[at[a], at[b]], size[at[a]] = int(s), int(na)
    never = np.iinfo(np.int64).max
    mean = np.full((n, n), never, dtype=np.int64)
    for i in range(n):
        for j in range(i + 1, n):
            mean[i, j] = total[i, j] // (size[i] * size[j])
    out = []
    for _ in range(n - 1):
        i, j = divmod(int(mean.argmin()), n)
        out.append((names[i], names[j], int(mean[i, j]), size[i], size[j]))
        total[i] += total[j]
        total[:, i] = total[i]
        size[i] += size[j]
        size[j] = 0
        mean[j], mean[:, j] = never, never
        for c in range(n):
            if c != i and size[c]:
                mean[min(i, c), max(i, c)] = total[i, c] // (size[i] * size[c])
    return pd.DataFrame(out, columns=["lo", "hi", "mean", "na", "nb"])


def linkage(scratch: Scratch, dist: DataFrame, *, small: int = SMALL) -> DataFrame:
    """The merges of average linkage: ``cluster_a, cluster_b, height, size_a, size_b``, one row fewer than samples.

    A cluster is named by its least sample, and the merge of a and b goes on as a (a < b). Nearest is the least mean distance (whole parts of
    1e-12), ties by names. Clusters that are each other's nearest are merged together in one round, which gives the merges that
    one at a time would give, as no merge brings a third cluster nearer. The last ``small`` clusters are merged in one task.
    """
    kind = dict(dist.dtypes)["sample_a"]
    units = F.round(F.col("distance") * float(UNIT)).cast("decimal(38,0)")
    links = dist.where("sample_a <> sample_b").select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"), units.alias("s"))
    links = scratch.cut(links)
    left = links.select("a").distinct().count()
    rows = f"lo {kind}, hi {kind}, mean long, na long, nb long"
    merges = [scratch.cut(dist.sparkSession.createDataFrame([], rows))]
    while left > small:
        mean = F.expr("s div (na * nb)")
        pair = F.struct(mean.alias("mean"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        size = lambda x: F.when(F.col("a") == F.least("a", "b"), F.col("na" if x == "a" else "nb")).otherwise(F.col("nb" if x == "a" else "na"))
        nearest = links.groupBy("a").agg(F.min(F.struct(pair.alias("pair"), size("a").alias("na"), size("b").alias("nb"))).alias("best"))
        mutual = nearest.groupBy("best").agg(F.count("*").alias("_n")).where("_n = 2").select("best.pair.lo", "best.pair.hi", "best.pair.mean", "best.na", "best.nb")
        merges.append(scratch.cut(mutual))
        left -= merges[-1].count()
        total = F.col("na") + F.col("nb")
        into = merges[-1].select(F.explode(F.array(*(F.struct(F.col(c).alias("of"), F.col("lo").alias("to"), total.alias("total")) for c in ("lo", "hi")))).alias("e")).select("e.*")
        moved = links
        for x in "ab":
            moved = moved.join(into.select(F.col("of").alias(x), F.col("to").alias(f"to_{x}"), F.col("total").alias(f"total_{x}")), x, "left")
        moved = moved.select(*(F.coalesce(f"to_{x}", x).alias(x) for x in "ab"), *(F.coalesce(f"total_{x}", f"n{x}").alias(f"n{x}") for x in "ab"), "s").where("a <> b")
        before, links = links, scratch.cut(moved.groupBy("a", "b", "na", "nb").agg(F.sum("s").cast("decimal(38,0)").alias("s")))
        scratch.drop(before)
    if left > 1:
        merges.append(scratch.cut(links.groupBy().applyInPandas(_merged_plainly, rows)))
    every = merges[0]
    for x in merges[1:]:
        every = every.unionByName(x)
    return scratch.cut(every.select(F.col("lo").alias("cluster_a"), F.col("hi").alias("cluster_b"), (F.col("mean") / float(UNIT)).alias("height"), F.col("na").alias("size_a"), F.col("nb").alias("size_b")))


def _followed(scratch: Scratch, up: DataFrame) -> DataFrame:
    """``sample, up, off`` with pointers followed to their ends and ``off`` added up on the way; an end points at itself with 0. Pointers are doubled in each round."""
    while True:
        ahead = up.select(F.col("sample").alias("up"), F.col("up").alias("_up"), F.col("off").alias("_off"))
        step = scratch.cut(up.join(ahead, "up").select("sample", F.col("_up").alias("up"), (F.col("off") + F.col("_off")).alias("off"), (F.col("up") != F.col("_up")).alias("_moved")))
        up = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return up


def groups(scratch: Scratch, dist: DataFrame, n_clusters: int = 2, *, small: int = SMALL) -> DataFrame:
    """``sample, cluster, leaf_order``: average linkage cut into ``n_clusters`` (all samples, if fewer), numbered from 1 by the order of the leaves.

    In the order of the leaves (from 0) the part of a merge with the least sample comes first.
    """
    if n_clusters < 1:
        raise ValueError("n_clusters must be positive")
    merges = linkage(scratch, dist, small=small)
    names = dist.select(F.col("sample_a").alias("sample")).distinct()
    parent = merges.select(F.col("cluster_b").alias("sample"), F.col("cluster_a").alias("_to"), F.col("size_a").alias("_off"))
    up = scratch.cut(names.join(parent, "sample", "left").select("sample", F.coalesce("_to", "sample").alias("up"), F.coalesce("_off", F.lit(0)).cast("long").alias("off")))
    leaves = _followed(scratch, up).select("sample", F.col("off").alias("leaf_order"))
    last = merges.orderBy(F.desc("height"), F.desc("cluster_a"), F.desc("cluster_b")).limit(n_clusters - 1).select(F.col("cluster_b").alias("sample"), F.lit(True).alias("_cut"))
    parts = up.join(last, "sample", "left").select("sample", F.when(F.col("_cut"), F.col("sample")).otherwise(F.col("up")).alias("up"), "off")
    parts = _followed(scratch, scratch.cut(parts)).select("sample", F.col("up").alias("_part"))
    both = scratch.cut(parts.join(leaves, "sample"))
    numbers = both.groupBy("_part").agg(F.min("leaf_order").alias("_first"))
    numbers = numbers.select("_part", F.row_number().over(Window.orderBy("_first")).cast("long").alias("cluster"))  # a row for each cluster
    return both.join(numbers, "_part").select("sample", "cluster", "leaf_order")


def cluster_samples(scratch: Scratch, dist: DataFrame, method: str = "mds", n_components: int = 2, metadata: DataFrame | None = None) -> DataFrame:
    """Samples laid out (``mds``) or grouped (``hclust``, into ``n_components`` clusters), with the columns of ``metadata`` (by ``sample``)."""
    if method not in ("mds", "hclust"):
        raise ValueError("method must be mds or hclust")
    out = layout(scratch, dist, n_components) if method == "mds" else groups(scratch, dist, n_components)
    return out if metadata is None else out.join(metadata, "sample", "left")
