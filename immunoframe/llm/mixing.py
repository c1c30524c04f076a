"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources get targets: weights share the total, a source is read at most ``most`` times, and what a source
   cannot give is shared again by weight among the others.
2. Each source is cut into ``blocks`` blocks, dealt by hash. Whole readings take all blocks; the rest of the
   target takes blocks in the order of a random permutation, and of the block where it ends, documents in such an order.
   While a source is off its target by more than ``NEAR`` of it, documents of about the size that it is short of
   or over are added or left out, until none would bring it nearer.
3. The blocks to be read (by source, as exact numbers) are split among the output shards down a binary tree.
   At each node a random half of its blocks goes left, so that the numbers of its sources there follow the
   multivariate hypergeometric distribution. All nodes draw from one random order of the blocks. Each shard then gets
   the next blocks of every source's permutation, so blocks are disjoint, and sorts its documents by a random key.

Everything is a DataFrame operation. What is decided is a row for each block (sources times ``blocks``) and for
the few documents that go another way than their block; texts are read once to be counted and once to be dealt out.
Windows run within blocks, over the blocks of one source, or within ranges of sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, whole_row

#: Parts into which a source is dealt where its documents meet its shortage; bins of the random order of all blocks.
PARTS, BINS = 128, 4096
#: A source as near to its target as this share of it is left alone.
NEAR = 1e-4
#: Rows of the plan up to which it is sent to every task (some 100 bytes each); a longer one is joined by shuffle.
SENT = 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def _n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _source_id(source: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("s"), source), F.lit("")))


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def targets(scratch: Scratch, sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target`` from one row for each source (``source``, ``source_size``).

    Sources are weighed in the order of their code points, null last, the weights repeating: they are sorted into
    ranges and numbered by range. The level of the words for a unit of weight rises as sources are full, until no
    other source is.
    """
    ranged = scratch.cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", _before("n", Window.orderBy("range")).alias("start"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    s = scratch.cut(ranged.join(starts, "range").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("limit")))
    level, full = 0.0, -1
    while True:
        held = F.col("limit") <= F.col("weight") * F.lit(level)
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(held, F.col("limit"))).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("free"), F.count_if(held).alias("full")).first()
        if r["full"] == full or not r["free"]:
            return s.select("source", "source_size", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))
        full = r["full"]
        level = (r["all"] - (r["held"] or 0.0)) / r["free"]


def _tree(scratch: Scratch, units: DataFrame, seed: int, levels: int) -> DataFrame:
    """``source_id``, ``ends``: of each source's permuted units, where the share of each shard ends.

    ``units`` stand in a random order; the half that goes left at a node is the first half of what the node has, and
    the numbers by source at the leaves are the quotas of the shards.
    """
    key = F.xxhash64(F.lit(seed), "source_id", "block", "pass")
    drawn = scratch.cut(units.select("source_id", key.alias("key"), "block", "pass", F.pmod(F.shiftright(key, 20), F.lit(BINS)).alias("bin")))
    bins = drawn.groupBy("bin").agg(F.count("*").alias("n"))  # at most BINS rows
    bins = bins.select("bin", _before("n", Window.orderBy("bin")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("bin").orderBy("key", "source_id", "block", "pass")
    placed = drawn.withColumn("nth", F.row_number().over(within)).join(bins, "bin")

    def descend(state: Column, _: Column) -> Column:
        half = F.floor((state["n"] + 1) / 2).cast("long")
        right = state["at"] > half
        return F.struct(
            F.when(right, state["n"] - half).otherwise(half).alias("n"),
            F.when(right, state["at"] - half).otherwise(state["at"]).alias("at"),
            (state["node"] * 2 + right.cast("int")).alias("node"),
        )

    start = F.struct(F.col("all").alias("n"), (F.col("start") + F.col("nth")).cast("long").alias("at"), F.lit(0).alias("node"))
    node = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, descend)["node"] if levels else F.lit(0)
    quotas = placed.select("source_id", node.alias("node")).groupBy("source_id", "node").agg(F.count("*").alias("q"))
    end = F.sum("q").over(Window.partitionBy("source_id").orderBy("node"))
    ends = quotas.withColumn("end", end).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("node", "end"))).alias("ends"))  # one entry for each shard
    return scratch.cut(ends)


@dataclass
class _Plan:
    """``blocks``: source_id, block, source_size, target, whole, extra, homes. ``singles``: documents that go another way, and their extra."""

    blocks: DataFrame
    singles: DataFrame
    sent: bool
    most: int
    shards: int

    def applied(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``source_id, block, mark, twin``) with ``source_size, target, copies, shards``."""
        blocks, singles = (F.broadcast(x) if self.sent else x for x in (self.blocks, self.singles))
        out = rows.join(blocks, ["source_id", "block"]).join(singles, ["source_id", "block", "mark", "twin"], "left")
        out = out.withColumn("copies", (F.col("whole") + F.coalesce("put", "extra", F.lit(0))).cast("int")).drop("put", "extra", "whole")
        # A document that was added needs a home beyond those of its block.
        spare = F.array(F.pmod("mark", F.lit(self.shards)).cast("int"))
        shards = F.slice(F.concat(F.coalesce("homes", F.array().cast("array<int>")), spare), F.lit(1), F.col("copies"))
        return out.withColumn("shards", shards).drop("homes")


def _keyed(docs: DataFrame, seed: int, text: str, blocks: int) -> dict[str, Column]:
    doc, source, mark = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col(text).cast("string"))
    return {"doc_id": doc, "source": source, "source_id": _source_id(source), "mark": mark, "twin": F.xxhash64(F.col(text).cast("string"), doc, F.lit(seed + 9)), "block": F.pmod(mark, F.lit(blocks)).cast("int")}


def _planned(scratch: Scratch, rows: DataFrame, weights: tuple[int, ...], most: int, seed: int, levels: int) -> _Plan:
    """``rows``: ``source, source_id, block, mark, twin, size``."""
    cut = scratch.cut
    blocks = cut(rows.groupBy("source_id", "source", "block").agg(F.sum("size").alias("words")))
    aims = targets(scratch, blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, most=most)
    aims = aims.withColumn("source_id", _source_id(F.col("source"))).drop("source")
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.expr("target / source_size + 1e-12"))).otherwise(0).cast("int"))
    aims = cut(aims.withColumn("rest", F.greatest(F.lit(0.0), F.expr("target - whole * source_size"))))
    permuted = Window.partitionBy("source_id").orderBy(F.xxhash64(F.lit(seed + 1), "source_id", "block"), "block")
    extra = F.expr("case when before >= rest then 0 when before + words <= rest then 1 end")
    placed = blocks.withColumn("before", _before("words", permuted)).join(aims, "source_id").withColumn("extra", extra).drop("source")
    placed = cut(placed)
    # In the one block of a source where the rest ends, documents in the order of their marks. Equal rows go together.
    ending = placed.where("extra is null").select("source_id", "block", "before", "rest")
    at = ["source_id", "block", "mark", "twin"]
    within = Window.partitionBy("source_id", "block").orderBy("mark", "twin")
    ended = rows.join(ending, ["source_id", "block"]).groupBy(*at, "before", "rest").agg(F.sum("size").alias("size"))
    ended = ended.withColumn("put", (F.col("before") + _before("size", within) + F.col("size") / 2 <= F.col("rest")).cast("int"))
    singles = cut(ended.select(*at, "put", "size"))
    while True:
        got = placed.where("extra = 1").select("source_id", F.col("words").alias("size")).unionByName(singles.where("put = 1").select("source_id", "size"))
        # Documents that were put in or out against their block count as such.
        undone = singles.join(placed.select("source_id", "block", "extra"), ["source_id", "block"]).where("extra = 1")
        got = got.unionByName(undone.select("source_id", (-F.col("size")).alias("size"))).groupBy("source_id").agg(F.sum("size").alias("got"))
        need = aims.join(got, "source_id", "left").withColumn("short", F.col("rest") - F.coalesce("got", F.lit(0)))
        need = cut(need.where(f"abs(short) > {NEAR} * target").select("source_id", "short", "whole"))
        able = rows.where("size > 0").join(need, "source_id").join(placed.select("source_id", "block", "extra"), ["source_id", "block"]).join(singles.select(*at, "put"), at, "left")
        able = able.groupBy(*at, "short", "whole", F.coalesce("put", "extra").alias("now")).agg(F.sum("size").alias("size"))
        able = able.where(f"(short > 0 and now = 0 and whole < {most} or short < 0 and now = 1) and abs(abs(short) - size) < abs(short)")
        off = F.abs(F.abs("short") - F.col("size"))
        best = able.groupBy("source_id", F.pmod("mark", F.lit(PARTS)).alias("part"), "short").agg(F.min(F.struct(off.alias("off"), "block", "mark", "twin", "now", "size")).alias("b"))
        best = best.select("source_id", "short", "b.*")
        nearest = Window.partitionBy("source_id").orderBy("off", "mark", "twin")  # at most PARTS rows
        best = best.withColumn("first", F.row_number().over(nearest)).withColumn("sum", F.sum("size").over(nearest)).where("first = 1 or sum <= abs(short)")
        best = cut(best.select(*at, (1 - F.col("now")).alias("put"), "size"))
        if best.isEmpty():
            break
        singles = cut(best.unionByName(singles.join(best, at, "left_anti")))
    # The units that the shards share: every block in each whole reading, and those that the rest begins.
    passes = F.sequence(F.lit(0), F.col("whole"))
    units = placed.select("source_id", "block", "before", "whole", "rest", F.explode(passes).alias("pass")).where("pass < whole or before < rest")
    order = Window.partitionBy("source_id").orderBy(F.xxhash64(F.lit(seed + 2), "source_id", "block", "pass"), "block", "pass")
    units = cut(units.select("source_id", "block", "pass", F.row_number().over(order).alias("rank")))
    ends = _tree(scratch, units, seed, levels)
    shard = F.element_at(F.filter("ends", lambda e: e["end"] >= F.col("rank")), 1)["node"]
    homes = units.join(ends, "source_id").groupBy("source_id", "block").agg(F.sort_array(F.collect_list(F.struct("pass", shard.alias("shard")))).alias("homes"))
    homes = homes.withColumn("homes", F.transform("homes", lambda x: x["shard"]))
    plan = cut(placed.join(homes, ["source_id", "block"], "left").select("source_id", "block", "source_size", "target", "whole", "extra", "homes"))
    singles = cut(singles.drop("size"))
    return _Plan(plan, singles, plan.count() + singles.count() <= SENT, most, 1 << levels)


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, blocks: int = 1024, levels: int = 6, text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, shards`` for every row of ``docs``.

    ``size`` counts words (null text: 0); ``taken`` is ``copies * size``; ``shards`` has the output shard of each copy,
    of ``2 ** levels`` shards. A null source is a source of its own, the last one. Documents without words are read
    with their blocks and take nothing. Order goes by hashes of id and text; rows of a source that are equal in both are
    taken alike; so reruns agree. Extra columns are ignored. No rows give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    keyed = _keyed(docs, seed, text, blocks)
    rows = scratch.cut(docs.select(*(c.alias(k) for k, c in keyed.items()), _n_words(F.col(text).cast("string")).alias("size")))
    out = _planned(scratch, rows, weights, most, seed, levels).applied(rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "shards")


def mixed_rows(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, blocks: int = 1024, levels: int = 6, text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """The mix itself: every copy as a row with all columns of ``docs``, sorted at random within its shard."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    keyed = _keyed(docs, seed, text, blocks)
    rows = scratch.cut(docs.select(*(keyed[k].alias(k) for k in ("source", "source_id", "block", "mark", "twin")), _n_words(F.col(text).cast("string")).alias("size")))
    plan = _planned(scratch, rows, weights, most, seed, levels)
    scratch.drop(rows)
    given = docs.select(whole_row(docs).alias("given"), *(keyed[k].alias(k) for k in ("source_id", "block", "mark", "twin")))
    copies = plan.applied(given).where("copies > 0").select("given", "mark", F.posexplode("shards").alias("copy", "shard"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("mark", "copy"), F.lit(max(1, -(-4 * tasks // plan.shards))))  # parts of a shard: some for each task
    key = F.xxhash64("mark", "copy", F.lit(11))
    return copies.withColumn("key", key).repartition("shard", part).sortWithinPartitions("shard", "key").select("given.*")
