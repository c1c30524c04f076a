"""Near matches of short sequences by exact key joins: no pair is compared unless it shares a key.

One substitution: keys are the sequence with one letter masked, so pairs that share a key are the pairs looked for and
nothing else. More substitutions: sequences are cut into pieces, of which similar ones share several, and only the rarest
pieces of each sequence are keys (prefix filter), so that what all junctions of a gene begin with joins nothing. Gaps: keys are
the sequence with letters left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch
from .graph import least_members


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _masked(seq: Column) -> Column:
    """The sequence with each letter masked in turn."""
    n = F.length(seq)
    cut = lambda i: F.concat(F.substring(seq, F.lit(1), i - 1), F.lit("\x01"), F.substring(seq, i + 1, n))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), cut)).otherwise(F.array().cast("array<string>"))


def _rare_pieces(items: DataFrame, seq: str, k: int, keys: list[str]) -> DataFrame:
    """``items`` with ``_key``: of 2 k + 2 pieces of a sequence the k + 1 rarest, of which similar ones share some."""
    m, n = 2 * k + 2, F.length(seq)
    start = lambda i: F.floor(n * i / m).cast("int")
    piece = lambda i: F.struct(n.alias("n"), i.alias("i"), F.substring(seq, start(i) + 1, start(i + 1) - start(i)).alias("s"))
    cut = items.withColumn("_key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), piece)))
    held = cut.groupBy(*keys, "_key").agg(F.count("*").alias("_held"))
    order = Window.partitionBy(*keys, seq).orderBy("_held", "_key")
    return cut.join(held, [*keys, "_key"]).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k + 1).drop("_held", "_nth")


def _substituted(x: DataFrame, y: DataFrame, k: int, keys: list[str], equal: bool) -> DataFrame:
    """``seq_a, seq_b, distance``: distinct sequences of ``x`` (``seq_a``) and ``y`` (``seq_b``) within ``keys`` with 1 to ``k`` substitutions, and equal ones if asked for."""
    if k <= 1:
        # A sequence as it is meets itself alone, one with a masked letter what differs there.
        whole = lambda c: F.array(F.col(c)) if equal else F.array().cast("array<string>")
        cut = lambda c: F.explode(F.concat(whole(c), _masked(F.col(c))) if k else whole(c))
        pairs = x.withColumn("_key", cut("seq_a")).join(y.withColumn("_key", cut("seq_b")), [*keys, "_key"])
        same, own = F.col("seq_a") == F.col("seq_b"), F.col("_key") == F.col("seq_a")
        return pairs.where(~same | own).select(*keys, "seq_a", "seq_b", F.when(same, 0).otherwise(1).alias("distance"))
    # Both sides rank pieces alike: counted over both.
    both = x.withColumnRenamed("seq_a", "_seq").unionByName(y.withColumnRenamed("seq_b", "_seq")).repartition(*keys, "_seq").distinct()
    rare = _rare_pieces(both, "_seq", k, keys)
    left = x.join(rare.withColumnRenamed("_seq", "seq_a"), [*keys, "seq_a"])
    right = y.join(rare.withColumnRenamed("_seq", "seq_b"), [*keys, "seq_b"])
    least = 0 if equal else 1
    pairs = left.join(right, [*keys, "_key"]).withColumn("distance", hamming(F.col("seq_a"), F.col("seq_b"))).where(F.col("distance").between(least, k))
    return pairs.select(*keys, "seq_a", "seq_b", "distance").distinct()


def substitution_pairs(items: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Both directions of all pairs of ``id, seq, n`` within ``keys`` with 1 to ``k`` substitutions: ``id_a, id_b, n_a, n_b, m``."""
    distinct = items.select(*keys, "seq").where("seq is not null").distinct()
    pairs = _substituted(distinct.withColumnRenamed("seq", "seq_a"), distinct.withColumnRenamed("seq", "seq_b"), k, keys, False)
    side = lambda x: items.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "seq", "n")))
    found = pairs.join(side("a"), [*keys, "seq_a"]).join(side("b"), [*keys, "seq_b"])
    return found.select(*keys, "id_a", "id_b", "n_a", "n_b", F.col("distance").alias("m"))


def _without(seq: Column, gaps: int) -> Column:
    """The sequence and what is left of it with up to ``gaps`` letters left out."""
    out = last = F.array(seq)
    for _ in range(gaps):
        fewer = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
        last = F.array_distinct(F.flatten(F.transform(last, fewer)))
        out = F.array_distinct(F.concat(out, last))
    return out


def _least_substitutions(a: str, b: str, ins: int, dels: int) -> int:
    """Least substitutions that turn ``a`` to ``b`` with exactly so many letters put in and left out; large if none do."""
    far = len(a) + len(b) + 1
    best = np.full((ins + 1, dels + 1), far)
    best[0, 0] = 0
    # state after i letters of a: (put in, left out) fixes the place in b
    for i in range(len(a) + 1):
        for p in range(ins + 1):
            for q in range(dels + 1):
                if p and 0 <= i + p - q <= len(b):
                    best[p, q] = min(best[p, q], best[p - 1, q])
        if i == len(a):
            break
        new = np.full_like(best, far)
        for p in range(ins + 1):
            for q in range(dels + 1):
                j = i + p - q
                if best[p, q] < far:
                    if 0 <= j < len(b):
                        new[p, q] = min(new[p, q], best[p, q] + (a[i] != b[j]))
                    if q < dels:
                        new[p, q + 1] = min(new[p, q + 1], best[p, q])
        best = new
    return int(best[ins, dels])


def _edits(subs: int, ins: int, dels: int, total: int):
    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            found = None
            for p in range(min(ins, total) + 1):
                q = p + len(x) - len(y)
                if 0 <= q <= dels and p + q <= total:
                    n = _least_substitutions(x, y, p, q)
                    if n <= subs and n + p + q <= total:
                        found = n + p + q if found is None else min(found, n + p + q)
            out.append(found)
        return pd.Series(out, dtype="Int32")

    return distance


def near_pairs(a: DataFrame, b: DataFrame, *, keys: list[str] = (), scope: str = "1,0,0,1", columns: tuple[str, str] = ("junction_aa", "junction_aa")) -> DataFrame:
    """Pairs of the distinct sequences ``seq_a, seq_b`` within ``keys`` whose edits fit ``substitutions,insertions,deletions,total``, and the fewest edits.

    Equal sequences pair with distance 0. With gaps, keys grow with the length to the power of the total, so totals are small.
    """
    subs, ins, dels, total = map(int, scope.split(","))
    subs, gaps, keys = min(subs, total), min(ins + dels, total), list(keys)
    x = a.select(*keys, F.col(columns[0]).alias("seq_a")).where("seq_a is not null").distinct()
    y = b.select(*keys, F.col(columns[1]).alias("seq_b")).where("seq_b is not null").distinct()
    if gaps == 0:
        return _substituted(x, y, subs, keys, True)
    x, y = (d.withColumn("_k", F.explode(_without(F.col(s), total))) for d, s in ((x, "seq_a"), (y, "seq_b")))
    pairs = x.join(y, [*keys, "_k"]).where(F.levenshtein("seq_a", "seq_b") <= total).select(*keys, "seq_a", "seq_b").distinct()
    return pairs.withColumn("distance", _edits(subs, ins, dels, total)("seq_a", "seq_b")).where("distance is not null")


def components(edges: DataFrame, nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root`` for all ``nodes`` (``node``): the least member of each component of the links ``a, b``."""
    return least_members(scratch or Scratch(nodes.sparkSession, "components"), edges, nodes)


def metaclonotypes(df: DataFrame, *, scope: str = "1,0,0,1", match_v: bool = True, match_j: bool = True) -> DataFrame:
    """The distinct keys (junction, and V and J call where they must match) with ``meta``, the least key of their single-linkage component.

    Null junctions have no row; a null call matches a null call. Groups are named by their least member, not numbered, so that
    no order over all groups is needed.
    """
    calls = [c for c, on in (("v_call", match_v), ("j_call", match_j)) if on and c in df.columns]
    plain = df.where("junction_aa is not null").select("junction_aa", *(F.coalesce(c, F.lit("")).alias(c) for c in calls)).distinct()
    pairs = near_pairs(plain, plain, keys=calls, scope=scope).where("seq_a < seq_b")
    node = lambda seq: F.concat_ws("|", *calls, seq)
    roots = components(pairs.select(node("seq_a").alias("a"), node("seq_b").alias("b")), plain.select(node("junction_aa").alias("node")))
    named = plain.withColumn("node", node("junction_aa")).join(roots, "node")
    return named.select("junction_aa", *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in calls), F.col("root").alias("meta"))
