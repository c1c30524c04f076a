"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Tokenising and cutting run as Arrow tasks. Packing itself depends on lengths alone, and there are at most
``size`` of them: the histogram of piece lengths (``size`` rows, whatever the corpus) is all that the driver
sees. On it,

* the reduction fixes sets that dominate every alternative: a piece that goes with no other, a piece with its
  exact complement, a piece that can have one companion only, and a piece whose largest companion is at
  least as large as any feasible pair in place of it. Each removal shrinks the instance;
* the remainder is packed best-fit decreasing, in blocks of equal sequences.

The plan says, for each length, which ranks go where. Ranks are counted in a distributed way (salted counts
and prefix sums), so no length is ever gathered in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernels import Words, slices

#: Ranges into which the pieces of one length are dealt for ranking.
SALTS = 512
#: Distinct parts of words whose ids a task remembers.
MEMORY = 800_000

_LETTER, _DIGIT, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = _MARK


class WordTokenizer:
    """Token ids of whole texts, encoding each distinct part of a word once.

    For tokenizers that lower-case A-Z, drop white space and never join a letter, a digit and a mark (as the
    word-level BPE files do), the ids of a text are those of its parts, one after the other. Parts end at ASCII
    white space and between ASCII letters, digits and marks, but never beside an apostrophe, which may
    start a contraction, and only before ASCII, as anything else may combine. Where a text spells a special
    token, whole words are encoded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.heads = np.zeros(1, np.int64)

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        used, base = int(self.heads[-1]), len(self.heads) - 1
        ends = used + np.cumsum([len(x) for x in ids])
        if ends[-1] > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(int(ends[-1]) + len(self.flat), np.uint32))
        self.flat[used : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) - used)
        self.heads = np.append(self.heads, ends)
        self.known.update(zip(keys, range(base, base + len(keys)), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of ``column``, and the number of ids by row."""
        words = Words(column, lower=False)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        if b"<|" not in (data := words.data.tobytes()):
            kind = _KIND[words.data]
            letters = np.zeros(len(kind), bool)  # the last bytes of two-byte Latin letters, which marks and digits don't combine with
            letters[1:] = (words.data[:-1] == 0xC3) & (words.data[1:] != 0x97) & (words.data[1:] != 0xB7)
            before = np.where(letters, _LETTER, kind)
            cut = (before[:-1] > 0) & (kind[1:] > 0) & ((before[:-1] != kind[1:]) | (kind[1:] == _DIGIT))
            words.split(np.flatnonzero(cut) + 1)
            words.lower()
            data = words.data.tobytes()
        codes, distinct = pd.factorize(words.hashes())
        if len(self.known) > MEMORY:
            self._forget()
        keys = distinct.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            first = np.full(len(keys), -1)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            at = first[new]
            self._learn([keys[i] for i in new], [data[s:e].decode() for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
        known = self.known
        place = np.array([known[h] for h in keys])[codes]
        n = self.heads[place + 1] - self.heads[place]
        total = np.append(0, np.cumsum(n))
        at = np.arange(total[-1]) + np.repeat(self.heads[place] - total[:-1], n)
        return self.flat[at], total[words.first + words.counts] - total[words.first]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids, counts = _TOKENIZERS[path].encode(batch.column("text").slice(a, b - a))
                rows, starts, lengths, sums = [], [], [], []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    for s in range(0, n + 1, size):
                        part = own[s : s + size]
                        rows.append(i)
                        starts.append(s)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                names = batch.column("doc_id").slice(a, b - a).take(pa.array(rows, pa.int64()))
                piece = pa.array(np.array(starts, np.int64) // size)
                yield pa.RecordBatch.from_arrays([names, piece, *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: how many, and the (length, number) that each of them holds."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    done: list[tuple[int, list[tuple[int, int]]]] = []
    places = np.arange(size + 1)

    def reduce_once() -> bool:
        changed = False
        for w in np.flatnonzero(left)[::-1].tolist():
            while left[w] > 0:
                others = left.copy()
                others[w] -= 1
                alive = np.flatnonzero(others)
                room = size - w
                fits = alive[alive <= room]
                if not len(fits):
                    done.append((int(left[w]), [(w, 1)]))  # goes with no other
                    left[w] = 0
                    changed = True
                    break
                best = int(fits[-1])
                if best != room:
                    # The largest pair that could stand in place of the best companion.
                    last = np.maximum.accumulate(np.where(others > 0, places, 0))
                    mate = last[room - fits]
                    alone = (mate == fits) & (others[fits] < 2)
                    mate = np.where(alone, last[np.maximum(fits - 1, 0)], mate)
                    pair = np.where(mate > 0, fits + mate, 0).max()
                    if pair > best:
                        break
                    least = np.repeat(alive[:3], np.minimum(others[alive[:3]], 3))[:3]
                    if pair > 0 and len(least) == 3 and least.sum() <= room:
                        break  # three might fit
                t = int(left[w] // 2 if best == w else min(left[w], left[best]))
                done.append((t, [(w, 2)] if best == w else [(w, 1), (best, 1)]))
                left[w] -= t * (2 if best == w else 1)
                if best != w:
                    left[best] -= t
                changed = True
        return changed

    while reduce_once():
        pass
    open_: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, n: int, held: tuple) -> None:
        if n:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
            open_[room].append((n, held))

    for w in np.flatnonzero(left)[::-1].tolist():
        n = int(left[w])
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                m, held = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, m, held = size, n, ()
            k = room // w
            full = min(m, n // k)
            put(room - k * w, full, (*held, (w, k)))
            n -= full * k
            m -= full
            if n and m and n < k:
                put(room - n * w, 1, (*held, (w, n)))
                m, n = m - 1, 0
            if room < size:
                put(room, m, held)
    return done + [(m, list(held)) for groups in open_.values() for m, held in groups]


def _places(groups: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """By length and rank: first rank, sequence of the first, how many in a sequence, and their offset there."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for m, held in groups:
        offset = 0
        for length, k in held:
            rows.append(((length << 44) + rank[length], sequence, k, offset))
            rank[length] += m * k
            offset += length * k
        sequence += m
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def _assign(places: tuple[np.ndarray, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, per, offset = places
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            key = (length << 44) + rank
            i = np.searchsorted(keys, key, side="right") - 1
            beyond = key - keys[i]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[i] + beyond // per[i]), pa.array(offset[i] + beyond % per[i] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, size: int = 4096, end: int = 1, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row for each piece of each row.

    ``tokenizer``: path of a word-level tokenizer file that every executor can read. A document is its ids and
    then ``end``; null or empty text is ``end`` alone. Documents of more than ``size`` tokens are cut into pieces of
    ``size``. Null ids and repeated rows are packed as they come, each row by itself; extra columns are
    ignored; no rows give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = scratch.cut(given.mapInArrow(_pieces(tokenizer, size, end), "doc_id long, piece long, start long, length long, ids_crc32 long").withColumn("row", F.monotonically_increasing_id()))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.pmod("row", F.lit(64))), F.lit(SALTS)))
    counts = scratch.cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = salted.withColumn("place", F.row_number().over(within)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place") - 1).alias("rank"))
    out = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_assign(_places(plan(histogram, size))), out)
