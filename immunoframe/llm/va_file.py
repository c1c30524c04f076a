"""Hard negatives by a vector-approximation file.

Vectors are integers: ``floor(scale * x)`` of each component. Equal vectors of one label are one node with its smallest ids, as many as an
answer can need. Nodes are dealt to blocks of about ``ROWS`` components; in each block every dimension is cut into ``CELLS`` cells of equally
many nodes, and the file holds one byte a component, the cell, with the least and largest value of every cell.

A scan looks up the ends of a node's cells and adds, over the dimensions, the smaller and the larger product with the anchor's
component: bounds of the score. (The ends are looked up for a whole block and multiplied with the positive and the
negative parts of many anchors, which is the sum of the anchors' lookup tables.) Four scans, of blocks with parts of the anchors:

1. of the nodes of the anchor's label, the largest lower bounds: the last of them is a threshold;
2. the nodes whose upper bound reaches it, which are scored exactly: positives, and by their scores the windows;
3. of the nodes of other labels that are certainly within a window, the largest lower bounds;
4. the nodes that may be within the window and reach that threshold, which are scored exactly: negatives.

Only the original vectors of candidates are read. Nothing is sampled or fitted beforehand, so any table is handled alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Components of the nodes of a block, and of the anchors of a part; cells of a dimension; anchors bounded at a time.
ROWS, ASKED, CELLS, AT_ONCE = 1 << 18, 1 << 17, 64, 256
#: Partial results of an anchor that are merged first in so many groups.
SALTS = 64
_LARGEST = (1 << 63) - 1


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each component (rows x dims), and each cell's least and largest value (cells x dims)."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    starts = np.unique(np.arange(CELLS) * n // CELLS)
    ends = np.append(starts[1:], n)
    codes = np.empty(x.shape, np.uint8)
    np.put_along_axis(codes, order, np.repeat(np.arange(len(starts), dtype=np.uint8), ends - starts)[:, None], axis=0)
    ordered = np.take_along_axis(x, order, axis=0)
    return codes, ordered[starts], ordered[ends - 1]


def bounds(q: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of anchors ``q`` with the rows that ``codes`` stand for."""
    at = np.arange(codes.shape[1])
    least, most = low[codes, at], high[codes, at]
    signed = np.concatenate([np.maximum(q, 0.0), np.minimum(q, 0.0)], axis=1)
    below = signed @ np.concatenate([least, most], axis=1).T
    above = signed @ np.concatenate([most, least], axis=1).T
    size = np.abs(q).max(initial=0.0) * max(np.abs(low).max(initial=0.0), np.abs(high).max(initial=0.0)) * codes.shape[1]
    slack = 0.0 if size < 2.0**53 else size * 2.0**-45  # beyond, sums of doubles are rounded
    return below - slack, above + slack


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers; those beyond a long are the largest or smallest long."""
    if not a.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([max(-_LARGEST, min(_LARGEST, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


def _approximate(rows: pa.Table) -> pa.Table:
    dims = rows["dims"][0].as_py()
    codes, low, high = cells(_matrix(rows["v"], dims))
    lists = [pa.array([rows[c].to_pylist()], pa.list_(pa.int64())) for c in ("node", "label")]
    return pa.table([rows["dims"].slice(0, 1), rows["block"].slice(0, 1), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in (codes, low, high))], ["dims", "block", "nodes", "labels", "codes", "low", "high"])


class _Block:
    """One block of the file with some anchors: bounds, anchors ``AT_ONCE`` at a time."""

    def __init__(self, file: pa.Table, asked: pa.Table) -> None:
        self.dims = file["dims"][0].as_py()
        self.nodes, labels = (np.array(file[c][0].as_py(), np.int64) for c in ("nodes", "labels"))
        self.codes = np.frombuffer(file["codes"][0].as_py(), np.uint8).reshape(-1, self.dims)
        self.low, self.high = (np.frombuffer(file[c][0].as_py(), np.float64).reshape(-1, self.dims) for c in ("low", "high"))
        self.labels, self.asked = labels, asked

    def __iter__(self):
        for at in range(0, self.asked.num_rows, AT_ONCE):
            part = self.asked.slice(at, AT_ONCE)
            same = part["label"].to_numpy()[:, None] == self.labels[None]
            yield part, same, *bounds(_matrix(part["v"], self.dims), self.codes, self.low, self.high)


def _best(values: np.ndarray, k: int) -> list[list[float]]:
    """By row, the ``k`` largest finite values."""
    if values.shape[1] > k:
        values = -np.partition(-values, k - 1, axis=1)[:, :k]
    return [[x for x in row if x > -np.inf] for row in values.tolist()]


def _windows(part: pa.Table, low: int, high: int, sure: bool):
    """By place, rows of anchors that have so many windows, their positive scores, and the windows' ends; rounded inwards if ``sure``, else outwards."""
    held = [[(w["p"], w["least"]) for w in ws] for ws in part["windows"].to_pylist()]
    by = 1e-12 if sure else -1e-12
    for k in range(max(map(len, held), default=0)):
        rows = np.array([i for i, ws in enumerate(held) if len(ws) > k])
        p, least = (np.array([held[i][k][j] for i in rows]) for j in (0, 1))
        f = p.astype(np.float64)
        yield rows, p, (f * low / 100 * (1 + by))[:, None], (f * high / 100 * (1 - by))[:, None], np.array([-np.inf if x is None else x for x in least], np.float64)[:, None]


def _scan(run, names: list[str], types: list[pa.DataType]):
    """A function of a block and anchors from one that yields rows."""

    def scan(file: pa.Table, asked: pa.Table) -> pa.Table:
        got = list(run(_Block(file, asked))) if file.num_rows and asked.num_rows else []
        columns = [pa.concat_arrays([pa.array(c[i], t) for c in got]) if got else pa.array([], t) for i, t in enumerate(types)]
        return pa.table(columns, names)

    return scan


def _same_label(k: int):
    def run(block: _Block):
        for part, same, below, _ in block:
            yield part["node"].to_numpy(), _best(np.where(same, below, -np.inf), k)

    return _scan(run, ["a", "lows"], [pa.int64(), pa.list_(pa.float64())])


def _reaching(block: _Block):
    for part, same, _, above in block:
        least = np.array([-np.inf if x is None else x for x in part["least"].to_pylist()], np.float64)
        row, col = np.nonzero(same & (above >= least[:, None]))
        yield part["node"].to_numpy()[row], block.nodes[col]


def _within(low: int, high: int, k: int):
    def run(block: _Block):
        for part, same, below, above in block:
            for rows, p, start, end, _ in _windows(part, low, high, True):
                sure = ~same[rows] & (below[rows] >= start) & (above[rows] <= end)
                yield part["node"].to_numpy()[rows], p, _best(np.where(sure, below[rows], -np.inf), k)

    return _scan(run, ["a", "p", "lows"], [pa.int64(), pa.int64(), pa.list_(pa.float64())])


def _entering(low: int, high: int):
    def run(block: _Block):
        for part, same, below, above in block:
            may = np.zeros(same.shape, bool)
            for rows, _, start, end, least in _windows(part, low, high, False):
                may[rows] |= ~same[rows] & (below[rows] <= end) & (above[rows] >= np.maximum(start, least))
            row, col = np.nonzero(may)
            yield part["node"].to_numpy()[row], block.nodes[col]

    return _scan(run, ["a", "x"], [pa.int64(), pa.int64()])


def _scored(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            dims, out = np.asarray(part["dims"]), np.zeros(part.num_rows, np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                out[rows] = scores(*(_matrix(part[c].take(pa.array(rows)), int(d)) for c in ("va", "vx")))
            yield pa.RecordBatch.from_arrays([part["a"], part["ids"], pa.array(out)], ["a", "ids", "score"])


class _File:
    """The nodes, their approximations, and the scans."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, asked: DataFrame) -> None:
        self.scratch, self.nodes, self.asked = scratch, nodes, asked
        count = lambda df, of, name: df.groupBy("dims").agg(F.ceil(F.count("*") * F.col("dims") / of).alias(name))
        self.plan = scratch.cut(count(nodes, ROWS, "blocks").join(count(asked, ASKED, "parts"), "dims"))
        placed = nodes.join(self.plan, "dims").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        schema = "dims int, block long, nodes array<long>, labels array<long>, codes binary, low binary, high binary"
        self.file = scratch.cut(placed.select("dims", "block", "node", "label", "v").groupBy("dims", "block").applyInArrow(_approximate, schema))

    def scan(self, asked: DataFrame, run, schema: str) -> DataFrame:
        each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
        file = self.file.join(self.plan, "dims").withColumn("part", each("parts")).drop("blocks", "parts")
        asked = asked.join(self.plan, "dims").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("block", each("blocks")).drop("blocks", "parts")
        key = ["dims", "block", "part"]
        return file.groupBy(*key).cogroup(asked.toDF(*asked.columns).groupBy(*key)).applyInArrow(run, schema)

    @staticmethod
    def kth(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        """The ``k``-th largest of the values ``lows`` by ``keys``, null if there are fewer; merged in two steps, each of bounded groups."""
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("lows")), False), 1, k).alias("lows")
        some = found.groupBy(*keys, F.floor(F.rand(7) * SALTS).alias("salt")).agg(merged)
        return some.groupBy(*keys).agg(merged).select(*keys, F.when(F.size("lows") >= k, F.element_at("lows", -1)).alias("least"))

    def exact(self, pairs: DataFrame) -> DataFrame:
        """``a, ids, score`` of candidate pairs ``a, x`` of nodes."""
        right = self.nodes.select(F.col("node").alias("x"), "dims", "ids", F.col("v").alias("vx"))
        left = self.asked.select(F.col("node").alias("a"), F.col("v").alias("va"))
        return pairs.join(right, "x").join(left, "a").mapInArrow(_scored, "a long, ids array<long>, score long")


def hard_negatives(rows: DataFrame, anchor: Column, *, vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows of ``vec_id`` for which ``anchor`` holds. Scores are inner products of the integers ``floor(scale * x)``; higher ones come
    first, ties by smaller ``vec_id``. An anchor's positives are its first ``positives`` other rows of the same label; for each, the first ``negatives``
    rows of other labels with ``low * positive <= 100 * negative <= high * positive`` are returned (fewer, if there are fewer).

    Rows with a null ``vec_id``, label or vector, an empty vector, or a null or non-finite component take no part. Vectors of different lengths
    are not compared. Of rows that repeat an id, the one with the largest label, then vector, stands for it. Labels
    are cast to long. Integers and scores beyond a long are the largest or smallest long. Extra columns are ignored; no rows give no rows.
    """
    scratch = scratch or Scratch(rows.sparkSession, "hard-negatives")
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = base.where("vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    base = base.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    base = scratch.cut(base.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("row"), F.bool_or("anchor").alias("anchor")).select("vec_id", "row.label", "row.v", "anchor"))

    most = max(positives + 1, negatives)
    first = base.withColumn("at", F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))).where(F.col("at") <= most)
    nodes = first.groupBy("label", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = scratch.cut(nodes.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("dims"), "label", "v", "ids"))
    anchors = scratch.cut(base.where("anchor").join(nodes.select("node", "label", "v"), ["label", "v"]).select(F.col("vec_id").alias("anchor_id"), F.col("node").alias("a")))
    asked = scratch.cut(nodes.join(anchors.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", "dims", "label", "v"))
    file = _File(scratch, nodes, asked)

    k = positives + 1  # the anchor itself may be among them
    least = file.kth(file.scan(asked, _same_label(k), "a long, lows array<double>"), ["a"], k)
    bounded = asked.join(least.withColumnRenamed("a", "node"), "node", "left")
    near = file.exact(scratch.cut(file.scan(bounded, _scan(_reaching, ["a", "x"], [pa.int64(), pa.int64()]), "a long, x long")))
    near = near.select("a", "score", F.explode("ids").alias("positive_id"))
    near = scratch.cut(near.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "positive_id"))).where(F.col("at") <= k))
    others = anchors.join(near, "a").where("positive_id != anchor_id")
    chosen = others.withColumn("at", F.row_number().over(Window.partitionBy("anchor_id", "a").orderBy(F.desc("score"), "positive_id"))).where(F.col("at") <= positives)
    chosen = scratch.cut(chosen.select("anchor_id", "a", "positive_id", F.col("score").alias("p")))

    wanted = scratch.cut(chosen.where("p >= 0").select("a", "p").distinct())
    windows = lambda df: asked.join(df.groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("p", "least")).alias("windows")), "node")
    sure = file.kth(file.scan(windows(wanted.withColumn("least", F.lit(None).cast("double"))), _within(low, high, negatives), "a long, p long, lows array<double>"), ["a", "p"], negatives)
    reach = scratch.cut(windows(wanted.join(sure, ["a", "p"], "left")))
    far = file.exact(scratch.cut(file.scan(reach, _entering(low, high), "a long, x long")))
    d = lambda x: x.cast("decimal(38,0)")
    fits = (d(F.col("p")) * low <= d(F.col("score")) * 100) & (d(F.col("score")) * 100 <= d(F.col("p")) * high)
    far = far.join(wanted, "a").where(fits).select("a", "p", "score", F.explode("ids").alias("negative_id"))
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("score"), "negative_id"))).where(F.col("rank") <= negatives)
    out = chosen.join(far, ["a", "p"])
    return scratch.result(out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), F.col("score").alias("negative_score")))
