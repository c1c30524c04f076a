"""Nearest neighbours by inner product through multi-index hashing of learned rotated binary codes.

Fit, on a bounded sample: vectors are extended by one coordinate that gives all of them one norm, so that the
largest inner product is the smallest angle; centred sample vectors are rotated to their principal axes and then
so that signs lose least (iterative quantisation), from several starts. The signs are the code, and it is cut into
substrings of about as many bits as number the vectors. For ``ASKED`` sampled queries (queries may be unlike the rows) the exact neighbours
among all rows are found; from their codes follow the substring radius ``s``, the number of substrings that finds ``FOUND`` of
these neighbours at the least cost, and the radius of the whole code (its first ``WHOLE`` bits) that holds ``HELD`` of them.

Index: each distinct vector stands once under each substring value, in a table dealt by substring and by the leading
bits of the value, with its whole code. Search: each query goes to the parts of the table that values within ``s`` of its own can be in, and
there looks up just these values. By the pigeonhole every code within ``m (s + 1) - 1`` bits is found in some of the ``m``
substrings; what is found, these and others, is checked by the whole code, and what is within its radius is
ranked by the float vectors. Queries that found fewer than ``k`` rows are asked again with larger radii, at last with all.

Repeated vectors are one node with its smallest ids, as many as a query can need; overfull parts of the table are split.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Sampled vectors for the fit, rounds of quantisation, sampled queries, substrings at most, rows of a part of the table.
SAMPLE, ROUNDS, ASKED, PARTS, BLOCK = 4096, 12, 128, 64, 16384
#: Bits of a whole code; bits of a substring, at least and at most.
WHOLE, WIDTHS = 320, (16, 24)
#: Shares of the sampled queries' true neighbours: found by substring values, and within the whole radius.
FOUND, HELD = 0.96, 0.98
#: Costs that the fit weighs: of an index entry, and of a value or code that a query looks at.
ENTRY, LOOK = 20.0, 1.0


class Codes:
    """Learned codes: ``PARTS`` substrings of ``width`` bits, as one integer each, and the first ``WHOLE`` bits."""

    def __init__(self, sample: np.ndarray, norm: float, width: int, seed: int = 3) -> None:
        self.norm, self.width = norm, width
        x = self.extend(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        dims = x.shape[1]
        axes = np.linalg.eigh(x.T @ x / max(len(x), 1))[1][:, ::-1]
        rng = np.random.default_rng(seed)
        turns, p = [], x @ axes
        while sum(t.shape[1] for t in turns) < PARTS * width:
            r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.sign(p @ r).T @ p, full_matrices=False)
                r = (u @ v).T
            turns.append(axes @ r)
        self.turn = np.concatenate(turns, axis=1)[:, : PARTS * width]

    def extend(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors of norm one: rows by the largest norm and a last coordinate, queries by their own norm."""
        if query:
            return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
        x = x / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def __call__(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        bits = (self.extend(x, query) - (0 if query else self.mean)) @ self.turn > 0
        return bits.reshape(len(x), PARTS, self.width) @ (1 << np.arange(self.width, dtype=np.int32)), np.packbits(bits[:, :WHOLE], axis=1).view(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _code(codes: Codes, dims: int):
    """Codes of rows as index entries and, of those asked for, as queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            for at in range(0, len(x), 4096):
                both = [y for query in (False, True) for y in codes(x[at : at + 4096], query)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel())) for y in both]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(both[0])) for c in ("id", "asked")), *lists], ["id", "asked", "values", "code", "query_values", "query"])

    return run


def _neighbours(codes: Codes, q: np.ndarray, k: int, dims: int):
    """Of each batch, the ``k`` nearest to each of a few vectors: ``nth, score``, and how many bits of each substring and of the code differ."""
    values, whole = codes(q, query=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            if not len(x):
                continue
            score = q @ x.T
            top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
            nth = np.repeat(np.arange(len(q)), top.shape[1])
            own_values, own = codes(x[top.ravel()])
            off = np.concatenate([np.bitwise_count(values[nth] ^ own_values), np.bitwise_count((whole[nth] ^ own).view(np.uint64))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(nth, pa.int32()), pa.array(score[nth, top.ravel()]), pa.array([o.tobytes() for o in off], pa.binary())], ["nth", "score", "off"])

    return run


def _fit(off: np.ndarray, whole: np.ndarray, width: int, rows: int, queries: int) -> tuple[int, int, int]:
    """Substring radius, number of substrings and whole radius, from the bits (pairs x substrings, pairs) in which true neighbours differ."""
    best = None
    for s in range(width + 1):
        found = np.maximum.accumulate(off <= s, axis=1).mean(axis=0) if len(off) else np.ones(off.shape[1])
        enough = np.flatnonzero(found >= FOUND)
        if len(enough):
            m = int(enough[0]) + 1
            values = m * sum(math.comb(width, i) for i in range(s + 1))
            cost = m * rows * ENTRY + queries * (values + values / 2.0**width * rows) * LOOK
            if best is None or cost < best[0]:
                best = (cost, s, m)
    _, s, m = best
    return s, m, int(np.quantile(whole, HELD, method="higher")) if len(whole) else WHOLE


def _masks(bits: int, s: int) -> np.ndarray:
    """All masks of at most ``s`` of ``bits`` bits, by number of bits."""
    return np.array([sum(1 << i for i in c) for n in range(min(s, bits) + 1) for c in itertools.combinations(range(bits), n)], np.int64)


def _probe(width: int, lead: int, s: int, radius: int):
    """Pairs ``q, id`` of queries and entries of one part of the table; entries come before queries."""
    low = width - lead
    masks = _masks(low, s)
    reach = np.array([len(_masks(low, i)) for i in range(s + 1)])

    def look(entries: tuple, ids: np.ndarray, lead_value: int, value: np.ndarray, q: np.ndarray) -> Iterator[tuple]:
        own, codes, starts = entries
        left = s - np.bitwise_count((value >> low) ^ lead_value).astype(int)  # never negative: queries come only where they can reach
        for n in np.unique(left).tolist():
            rows = np.flatnonzero(left == n)
            values = (value[rows] & ((1 << low) - 1))[:, None] ^ masks[None, : reach[n]]
            lo, hi = starts[values], starts[values + 1]
            sizes = (hi - lo).ravel()
            total = int(sizes.sum())
            if not total:
                continue
            at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo.ravel(), sizes)
            qi = np.repeat(rows, (hi - lo).sum(axis=1))
            for c in range(0, total, 1 << 17):
                i, j = qi[c : c + (1 << 17)], at[c : c + (1 << 17)]
                good = np.bitwise_count((q[i] ^ codes[j]).view(np.uint64)).sum(axis=1, dtype=np.int32) <= radius
                yield ids[i[good]], own[j[good]]

    def table(parts: list) -> tuple:
        own, value, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
        value = value & ((1 << low) - 1)
        order = np.argsort(value, kind="stable")
        return own[order], codes[order], np.searchsorted(value[order], np.arange((1 << low) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, entries = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "lead", "salt")], axis=1)
            asks = batch.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            ids, value = batch.column("id").to_numpy(), batch.column("value").to_numpy().astype(np.int64)
            codes = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1).tolist(), len(asks)]
            for i, j in itertools.pairwise(cuts):
                if at is None or (keys[i] != at).any():
                    at, parts, entries = keys[i], [], None
                if not asks[i]:
                    parts.append((ids[i:j], value[i:j], codes[i:j]))
                    continue
                if entries is None and parts:
                    entries = table(parts)
                for c in range(i, j, 256):
                    end = min(j, c + 256)
                    for found in look(entries, ids[c:end], int(at[1]), value[c:end], codes[c:end]) if entries is not None else ():
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["q", "id"])

    return run


def _scored(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.einsum("ij,ij->i", _matrix(batch.column("w"), dims), _matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(score), batch.column("ids")], ["q", "score", "ids"])

    return run


class _Index:
    """The nodes of one vector length, and their search."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, dims: int, k: int) -> None:
        self.scratch, self.nodes, self.dims, self.k = scratch, nodes, dims, k
        self.rows, queries, norm = nodes.agg(F.count("*"), F.count_if("asked"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
        drawn = np.array([r["v"] for r in nodes.select("v", "a").orderBy("a").limit(SAMPLE).collect()])  # bounded by SAMPLE
        self.width = min(WIDTHS[1], max(WIDTHS[0], round(math.log2(self.rows))))
        codes = Codes(drawn, norm, self.width)
        asked = np.array([r["v"] for r in nodes.where("asked").select("v", "a").orderBy("a").limit(ASKED).collect()]).reshape(-1, dims)  # bounded by ASKED
        near = nodes.select("v").mapInArrow(_neighbours(codes, asked, k, dims), "nth int, score double, off binary")
        place = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("score"), "off"))
        near = near.withColumn("place", place).where(f"place between 2 and {k + 1}").select("off").collect()  # ASKED * k rows; the first is the vector itself
        off = np.frombuffer(b"".join(r["off"] for r in near), np.uint8).reshape(-1, PARTS + WHOLE // 64)
        self.s, self.m, self.radius = _fit(off[:, :PARTS], off[:, PARTS:].sum(axis=1), self.width, self.rows, queries)
        self.coded = scratch.cut(nodes.select("id", "asked", "v").mapInArrow(_code(codes, dims), "id long, asked boolean, values array<int>, code array<long>, query_values array<int>, query array<long>"))

    def pairs(self, asked: DataFrame, s: int, radius: int) -> DataFrame:
        """``q, id``: of the nodes ``asked`` (``id, values, code`` as queries), all nodes within ``s`` in some substring and within ``radius`` in the code."""
        lead = min(self.width, max(0, math.ceil(math.log2(max(1, self.rows / BLOCK)))))
        low, m = self.width - lead, self.m

        def parts(codes: DataFrame) -> DataFrame:  # by substring: its leading bits
            return codes.select("id", "code", F.posexplode(F.slice("values", 1, m)).alias("part", "value")).withColumn("lead", F.shiftright("value", low))

        entries = parts(self.coded)
        sizes = entries.groupBy("part", "lead").agg(F.floor(F.count("*") / (2 * BLOCK)).cast("int").alias("salts"))
        over = self.scratch.cut(sizes.where("salts > 1"))  # parts of the table that are split
        split = not over.isEmpty()
        salts = (lambda df: df.join(over, ["part", "lead"], "left").fillna(1, ["salts"])) if split else (lambda df: df.withColumn("salts", F.lit(1)))
        entries = salts(entries).withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).drop("salts").withColumn("ask", F.lit(False))
        asks = parts(asked)
        flips = F.array(*(F.lit(int(x)) for x in _masks(lead, s)))
        asks = asks.withColumn("lead", F.explode(F.transform(flips, lambda x: F.col("lead").bitwiseXOR(x))))
        asks = salts(asks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)) if split else F.lit(0)).drop("salts").withColumn("ask", F.lit(True))
        both = entries.unionByName(asks)
        dealt = both.repartition("part", "lead", "salt").sortWithinPartitions("part", "lead", "salt", "ask")
        return dealt.mapInArrow(_probe(self.width, lead, s, radius), "q long, id long").distinct()

    def best(self, asked: DataFrame, s: int, radius: int) -> DataFrame:
        """``q, near``: for each node asked for, its ``k + 1`` nearest rows as (score, id), the query's own id among them."""
        found = self.scratch.cut(self.pairs(asked, s, radius))
        found = found.join(self.nodes.select("id", "v", "ids"), "id").drop("id")
        own = self.nodes.where("asked").select(F.col("id").alias("q"), F.col("v").alias("w"))
        found = found.join(own, "q").mapInArrow(_scored(self.dims), "q long, score double, ids array<long>")
        found = found.select("q", "score", F.explode("ids").alias("vec_id"))
        nearest = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        top = found.withColumn("place", F.row_number().over(nearest)).where(f"place <= {self.k + 1}")
        return self.scratch.cut(top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("near")))

    def search(self) -> DataFrame:
        asked = self.coded.where("asked").select("id", F.col("query_values").alias("values"), F.col("query").alias("code"))
        least = min(self.k + 1, self.nodes.agg(F.sum(F.size("ids"))).first()[0])
        s, radius, done = self.s, self.radius, None
        while True:
            got = self.best(asked, s, radius)
            enough = got.where(F.size("near") >= least) if s < self.width else got
            done = enough if done is None else done.unionByName(enough)
            if s >= self.width:
                return done
            asked = self.scratch.cut(asked.join(enough.select(F.col("q").alias("id")), "id", "left_anti"))
            if asked.isEmpty():
                return done
            s, radius = s + 2, radius + (WHOLE - radius + 1) // 2
            if s >= self.width // 2:
                s, radius = self.width, WHOLE


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose ``vec_id`` is divisible by ``every``, the ``k`` nearest other rows.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; vectors of
    several lengths are searched each among those of its own length. Rows that repeat id and vector are one; a repeated id is
    no candidate for its own query. Ties go to the smaller id. Extra columns are ignored. No rows give no rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "nearest")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    keyed = v.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(23), "v")})
    asks = keyed.where(F.col("vec_id") % every == 0).select("a", "b", F.col("vec_id").alias("query_id")).distinct()
    # Of the rows of one vector, the smallest ids are all that a query can need.
    few = keyed.select("a", "b", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).where(f"n <= {k + 1}")
    few = few.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = keyed.groupBy("a", "b").agg(F.first("v").alias("v"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    nodes = scratch.cut(one.join(few, ["a", "b"]).withColumn("id", F.monotonically_increasing_id()))  # ids hold once written
    out = None
    for d in [r[0] for r in nodes.select(F.size("v")).distinct().collect()]:  # the lengths of vectors
        own = nodes if out is None and nodes.where(F.size("v") != d).isEmpty() else scratch.cut(nodes.where(F.size("v") == d))
        got = _Index(scratch, own, d, k).search()
        out = got if out is None else out.unionByName(got)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asks.join(nodes.where("asked").select("a", "b", F.col("id").alias("q")), ["a", "b"]).join(out, "q").select("query_id", F.explode("near").alias("x"))
    asked = asked.select("query_id", F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score")).where("vec_id != query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.withColumn("rank", F.row_number().over(best).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
