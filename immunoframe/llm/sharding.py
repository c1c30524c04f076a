"""Sharding by sampled splitters.

Records are ordered by a key (a hash of the text, then one of the id, then one of the row as written), so copies stand
together, and even equal rows can be told apart. A sample of the
keys, drawn with a chance in proportion to record sizes, gives quantile boundaries of many fine ranges. The
exact bytes of all ranges are then counted; ranges that came out overfull (a large group of copies, an
unlucky sample) are subdivided by new splitters until none is. Prefix sums over ranges and within them
give every record its exact place in the order, and places are cut into shards of equal bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fine ranges, as coarse times fine ones; sampled keys for each range.
COARSE, FINE, SAMPLES = 40, 32, 20
#: A range is overfull if it has more than so many times its share.
OVERFULL = 4


def _hex(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def _splitters(keys: list[str], parts: int) -> list[str]:
    """Quantile boundaries of a sorted sample, each once."""
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _find(bounds: list[str], key: Column) -> Column:
    """How many of the sorted boundaries are at most ``key``, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    group = F.size(F.filter(heads, lambda b: b <= key))
    inner = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(group, F.lit(1)))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + F.size(F.filter(inner, lambda b: b <= key)))


def shard(docs: DataFrame, *, shards: int = 40, seed: int = 5, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, by the law ``bytes``.

    ``size``: UTF-8 bytes of the text (null: none) plus 16. Shards are of equal bytes, up to half a record at
    either end. ``slot`` counts the records of a shard from 0, in key order. Null ids, repeated rows and ties are
    in the order of the key, equal rows being interchangeable. A null text has its own key and the checksum of
    the empty text. Extra columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    given = F.col(text).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(given), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(given, F.lit(""))).alias("text_crc32"), F.concat(_hex(F.xxhash64(F.lit(seed), given)), _hex(F.xxhash64(F.lit(seed), "doc_id")), _hex(F.xxhash64(F.monotonically_increasing_id()))).alias("key"),
    )
    rows = scratch.cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = COARSE * FINE
    chance = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def sample(frame: DataFrame, of: int, number: int) -> list[str]:
        """About ``number`` keys of records that hold ``of`` bytes together: a bounded list."""
        picked = frame.where(chance * F.lit(max(of, 1) / number) < F.col("size"))
        return [r[0] for r in picked.select("key").orderBy("key").collect()]

    bounds = _splitters(sample(rows, total, ranges * SAMPLES), ranges)
    counted: list = []
    while True:
        placed = rows.withColumn("range", _find(bounds, F.col("key")))
        counted = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("range").collect()
        full = [r for r in counted if r["bytes"] > OVERFULL * total / ranges and r["lo"] != r["hi"]]
        more = set(bounds)
        for r in full:
            inside = rows.where(F.col("key").between(r["lo"], r["hi"]))
            parts = max(2, int(r["bytes"] * ranges / total))
            more |= set(_splitters(sample(inside, r["bytes"], parts * SAMPLES), parts)) | ({r["hi"]} if r["n"] < 2 * parts else set())
        if len(more) == len(bounds):
            break
        bounds = sorted(more)
    # Exact places: what stands before each range (a bounded table), and what stands before each record in it.
    starts, at, n = [], 0, 0
    for r in counted:
        starts.append((r["range"], at, n))
        at, n = at + r["bytes"], n + r["n"]
    starts = docs.sparkSession.createDataFrame(starts, "range int, bytes_before long, rows_before long")
    within = Window.partitionBy("range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.row_number().over(within)).join(F.broadcast(starts), "range")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1)))).cast("int")))
    placed = scratch.cut(placed.withColumn("place", F.col("rows_before") + F.col("nth") - 1).drop("upto", "nth", "rows_before", "bytes_before", "range"))
    heads = placed.groupBy("shard").agg(F.min("place").alias("head"))  # one row for each shard
    out = placed.join(F.broadcast(heads), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
