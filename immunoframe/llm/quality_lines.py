"""Quality rules from within-document counts and from cross-document line frequency.

Every line is normalised (lower case, single spaces) and hashed. For each host and line the operator counts
the distinct documents that hold it; lines held by more than the limit are furniture (menus, notices,
licence footers) and are removed, and a document of which too little is left is rejected.

A document counts by the hash of its whole normalised text (its normalised lines that aren't blank, in order):
copies of one document count once, so that a group of copies doesn't make its own text furniture, and
documents that differ anywhere count each, whatever lines they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernels import Words, slices, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\v\f\r"
_TOP = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _TOP else x


def _lines(text: str | None) -> tuple[int, dict[int, list[int]], int]:
    """Lines equal to an earlier one, by hash of normalised line its words in all and the line numbers, and the hash of all normalised lines."""
    repeats, seen, out, whole = 0, set(), {}, xxhash.xxh64()
    for i, line in enumerate((text or "").split("\n")):
        if not line.strip(_BLANK):
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        plain = " ".join(line.lower().split())
        whole.update(plain + "\n")
        entry = out.setdefault(_signed(xxhash.xxh64_intdigest(plain)), [0])
        entry[0] += len(line.split())
        entry.append(i)
    return repeats, out, _signed(whole.intdigest())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int32()))]))
    for batch in batches:
        column = batch.column("text")
        for a, b in slices(column):
            text = column.slice(a, b - a)
            words = Words(text, lower=False)
            hashes = words.hashes()
            rows = b - a
            ends = words.offsets
            heads = (words.data & 0xC0) != 0x80
            summed = lambda mask: np.diff(np.append(0, np.cumsum(mask))[ends])
            chars, symbols = summed(words.inside & heads), summed(_SYMBOL[words.data])
            grams, n = windows(hashes, words, 5)
            stops = np.cumsum(n)
            repeated = np.zeros(rows, np.int64)
            for i in np.flatnonzero(n > 1).tolist():
                own = grams[stops[i] - n[i] : stops[i]]
                order = np.sort(own)
                twice = order[1:][order[1:] == order[:-1]]
                if len(twice):
                    edge = np.zeros(len(own) + 5, np.int64)
                    at = np.flatnonzero(np.isin(own, twice))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + 5, -1)
                    repeated[i] = int((np.cumsum(edge) > 0).sum())
            copies, lines, whole = [], [], []
            for t in text.to_pylist():
                c, found, of = _lines(t)
                copies.append(c)
                whole.append(of)
                lines.append([{"line": h, "n": v[0], "at": v[1:]} for h, v in found.items()])
            columns = [batch.column(c).slice(a, rows) for c in ("row", "doc_id", "host", "of")]
            columns += [pa.array(x, pa.int64()) for x in (whole, words.counts, chars, symbols, copies, repeated)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, kind)], ["row", "doc_id", "host", "of", "whole", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


_MEASURED = "row long, doc_id long, host long, of struct<a: long, b: long>, whole long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, n: long, at: array<int>>>"


def _host(host: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("")))


def row_key(host: Column, text: Column) -> Column:
    """Two hashes of a row's host and text: rows that agree in it have one verdict."""
    return F.struct(F.xxhash64(_host(host), text.cast("string")).alias("a"), F.xxhash64(text.cast("string"), _host(host), F.lit(3)).alias("b"))


def quality_rules(
    docs: DataFrame, *, host: str = "source", text: str = "text", least_documents: int = 20, share: float = 0.01, least_words: int = 5, least_left: float = 0.2, with_lines: bool = False,
    with_keys: bool = False, scratch: Scratch | None = None,
) -> DataFrame:
    """The base counts, ``base_failed``, ``n_left`` (words outside removed lines) and ``kept``, for every row.

    A line is removed if more than ``max(least_documents, share * distinct documents of the host)`` distinct
    documents of its host hold it. A document is rejected if the base rules fail, or if removal leaves fewer than
    ``least_words`` words or less than ``least_left`` of its words. ``with_lines`` adds ``removed``, the
    numbers of the removed lines, for :func:`without_lines`; ``with_keys`` adds ``of``, :func:`row_key` of the row, as a row's
    verdict depends on its host and text alone.

    Null text has no words (so the base rules fail); a null host is a host of its own; null or repeated ids
    are judged row by row; repeated rows count as one document; extra columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality-rules")
    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _host(F.col(host)).alias("host"),
        row_key(F.col(host), F.col(text)).alias("of"), F.col(text).cast("string").alias("text"),
    )
    table = scratch.cut(given.mapInArrow(_measure, _MEASURED))
    lines = table.select("row", "host", "whole", F.explode("lines").alias("x")).select("row", "host", "whole", "x.*")
    held = lines.groupBy("host", "line", "whole").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > least_documents)
    sizes = scratch.cut(table.groupBy("host", "whole").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of")))
    common = scratch.cut(held.join(sizes, "host").where(F.col("documents") > F.col("of") * share).select("host", "line"))
    # One row a common line: small enough to send to every task, or else a shuffled join that splits hot lines.
    gone = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("n").alias("gone"), *([F.flatten(F.collect_list("at")).alias("removed")] if with_lines else []))
    out = table.drop("lines", "whole").join(gone, "row", "left").withColumn("n_left", F.greatest(F.lit(0), F.col("n_words") - F.coalesce("gone", F.lit(0))))
    out = out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    depleted = F.col("gone").isNotNull() & ((F.col("n_left") < least_words) | (F.col("n_left") < F.col("n_words") * least_left))
    kept = ~F.col("base_failed") & ~depleted
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*names, kept.alias("kept"), "n_left", *(["row", "removed"] if with_lines else []), *(["of"] if with_keys else []))


def without_lines(text, removed):
    """Column: the text without the lines numbered in ``removed`` (null: all stay)."""
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.coalesce(removed, F.array().cast("array<int>")), i))
    return F.array_join(left, "\n")
