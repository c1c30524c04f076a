"""Spelling variants: words one edit apart, by Aho-Corasick automata over the halves of all words.

One edit leaves one half of a word intact: the first half then stands at the start of the other word, the second half at its end.
Words are dealt to shards by length and hash, each of about ``SHARD`` letters; a shard's automaton holds both halves of its words.
Every word is scanned by the shards of its own length and of one letter more or less, in blocks of about ``BLOCK`` letters.
A match counts where its offset fits the half. What stands beside a matching half must then be one edit away: that is looked up
by hashes of it with one letter left out, so that a half which very many words share costs no more than another; then the two words are compared.

No shard or block grows with the table, and what a word can meet is bounded by its length and the alphabet.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernels import C1, C2, C3, mix64

#: Letters of the words of an automaton, of the words that it scans in one task, and of those at a time.
SHARD, BLOCK, SCAN = 400_000, 1_000_000, 100_000
#: What a word is made of.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Undoes a multiplication by C1.
_BACK = np.uint64(pow(int(C1), -1, 1 << 64))


def word_counts(docs: DataFrame, *, text: str = "text", least: int = 7, occurrences: int = 2, typo_every: int = 0) -> DataFrame:
    """``word, n``: the lower-cased (A-Z only) runs of letters of all whole texts, of ``least`` code points and ``occurrences`` and more.

    ``typo_every``: where it divides the crc32 of ``<doc_id>:<run>``, the run loses the code point at that number modulo its
    length (a repeatable test noise). A null text has no words; a null ``doc_id`` counts as an empty one. Extra columns are ignored.
    """
    run = F.translate("run", _UPPER, _LOWER)
    runs = F.filter(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0)), lambda x: F.length(x) >= least)
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("of"), F.explode(runs).alias("run")).select("of", run.alias("word"))
    if typo_every:
        words = words.withColumn("h", F.crc32(F.concat("of", F.lit(":"), "word")))
        words = words.withColumn("at", F.when(F.col("h") % typo_every == 0, (F.col("h") % F.length("word")).cast("int")))
        words = words.withColumn("word", F.expr("case when at is null then word else concat(substring(word, 1, at), substring(word, at + 2)) end")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _letters(words: list[str]) -> np.ndarray:
    """A random 64-bit number for each letter of words of one length: a row for each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return mix64(codes.astype(np.uint64) * C1 + C2)


def _shortened(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row, a hash of its letters, and hashes of what is left without each of them."""
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(letters.shape[1] - 1, 0), C1)]))[: letters.shape[1]]
    terms = letters * powers[None]
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = upto[:, -1] if letters.shape[1] else np.zeros(len(letters), np.uint64)
    return whole, upto - terms + (whole[:, None] - upto) * _BACK


class Shard:
    """The automaton of both halves of some words of one length, and keys of what stands beside them."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.size, self.cut = words, len(words[0]), len(words[0]) // 2
        ids: dict[str, int] = {}
        self.half = [np.array([ids.setdefault(w[part], len(ids)) for w in words], np.int64) for part in (slice(0, self.cut), slice(self.cut, None))]
        self.sizes = np.array([len(half) for half in ids], np.int64)
        self.empty = ids.pop("", None)
        self.automaton = ahocorasick.Automaton()
        for half, h in ids.items():
            self.automaton.add_word(half, h)
        self.automaton.make_automaton()
        letters = _letters(words)
        self.held = {more: [self._keys(self.half[role], rest, -more) for role, rest in enumerate((letters[:, self.cut :], letters[:, : self.cut]))] for more in (-1, 0, 1)}

    @staticmethod
    def _keys(half: np.ndarray, rest: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of rests that are ``more`` letters longer than those they are to fit, and the row of each."""
        whole, short = _shortened(rest)
        own = mix64(half.astype(np.uint64) * C2 + C3)
        if more < 0:
            keys, rows = mix64(whole + own), np.arange(len(rest))
        else:
            keys = short + own[:, None]
            keys = mix64((keys + np.arange(rest.shape[1], dtype=np.uint64) * C3 if more == 0 else keys).ravel())
            rows = np.repeat(np.arange(len(rest)), rest.shape[1])
        order = np.argsort(keys, kind="stable")
        return keys[order], rows[order]

    def near(self, asked: list[str]) -> list[tuple[int, int]]:
        """Pairs of places in ``asked`` (words of one length) and in the shard's words that are one edit apart."""
        length = len(asked[0])
        more = length - self.size
        found = np.array(list(self.automaton.iter("".join(asked))), np.int64).reshape(-1, 2)
        word, last = np.divmod(found[:, 0], length)
        size = self.sizes[found[:, 1]]
        letters, pairs = _letters(asked), []
        for role, width in ((0, self.cut), (1, self.size - self.cut)):
            if width > length:
                continue
            fits = (size == width) & (last == (width - 1 if role == 0 else length - 1))
            rows, half = word[fits], found[fits, 1]
            if not width:
                rows, half = np.arange(len(asked)), np.full(len(asked), self.empty)
            keys, of = self._keys(half, letters[rows, width:] if role == 0 else letters[rows, : length - width], more)
            held, at = self.held[more][role]
            low, high = (np.searchsorted(held, keys, side) for side in ("left", "right"))
            n = high - low
            own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            pairs.append(np.stack([np.repeat(rows[of], n), at[own]], axis=1))
        return [(a, b) for a, b in np.unique(np.concatenate(pairs), axis=0).tolist() if one_edit(asked[a], self.words[b])]


def _scan(held: pa.Table, scanned: pa.Table) -> pa.Table:
    got = []
    if held.num_rows:
        ns, shard = held["n"].to_pylist(), Shard(held["word"].to_pylist())
        by_size: dict[int, list[str]] = {}
        for word in scanned["word"].to_pylist():
            by_size.setdefault(len(word), []).append(word)
        for size, words in by_size.items():
            step = max(1, SCAN // size)
            for at in range(0, len(words), step):
                part = words[at : at + step]
                got += [(part[a], shard.words[b], ns[b]) for a, b in shard.near(part)]
    columns = zip(*got, strict=True) if got else [()] * 3
    return pa.table([pa.array(list(x), t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of ``words`` (distinct ``word``, and ``n``) that are one edit apart."""
    sized = words.where("word != ''").select("word", "n", F.length("word").cast("long").alias("size"))
    sizes = sized.groupBy("size").agg((F.count("*") * F.col("size")).alias("letters"))
    reach = sizes.select(F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias("size"), F.col("letters").alias("near"))
    plan = sizes.join(reach.groupBy("size").agg(F.sum("near").alias("near")), "size")
    plan = scratch.cut(plan.select(F.col("size").alias("held"), F.ceil(F.col("letters") / SHARD).alias("shards"), F.ceil(F.col("near") / BLOCK).alias("blocks")))
    place = lambda count: F.pmod(F.xxhash64("word"), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    held = sized.withColumnRenamed("size", "held").join(plan, "held").select("held", place("shards").alias("shard"), each("blocks").alias("block"), "word", "n")
    asked = sized.select("word", F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias("held")).join(plan, "held")
    asked = asked.select("held", each("shards").alias("shard"), F.pmod(F.xxhash64(F.lit(1), "word"), F.col("blocks")).alias("block"), "word").toDF("held", "shard", "block", "word")
    key = ["held", "shard", "block"]
    return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_scan, "word string, near string, near_n long")


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that the links ``word, form`` lead to, by doubling; links only lead to more frequent words, so they end."""
    now = scratch.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(words: DataFrame, *, ratio: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word``, ``n``).

    A word's form is the most frequent of the words one edit from it (ties: the smallest in code-point order) if that is ``ratio`` times
    as frequent, else null; ``root`` follows forms to the last. Repeated words are added up; null and empty words are left out;
    words of any other length and alphabet take part; no words give no rows; extra columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in circles")
    scratch = scratch or Scratch(words.sparkSession, "spelling-variants")
    words = scratch.cut(words.where("word != ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = near_words(words, scratch)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    known = scratch.cut(words.join(best, "word", "left").select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = _roots(scratch, known.where("form is not null"))
    out = known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return scratch.result(out)
