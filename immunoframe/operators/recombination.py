"""The recombination model over DataFrames: generation probabilities, sampling, and information measures.

A model is a set of small tables: genes with their probabilities and sequences, deletions by gene, insertion lengths, and
nucleotide transitions. Junctions are scored in Arrow batches, each distinct junction once; the model travels with the task.

One forward pass serves nucleotides, residues and wildcards: its state is the last two nucleotides, and what a position may be
(a base, or a base that completes an allowed codon) is a mask. Sums over segments, trims and inserts are sums of passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clonotype import CODONS, RESIDUES, translate
from ..sources.scratch import Scratch
from .ranks import kolmogorov_smirnov, quantiles, spearman

BASES = "ACGT"
_AT = {b: i for i, b in enumerate(BASES)}
#: Residue of each codon, by the numbers of its bases.
_CODE = np.array([[[CODONS[a + b + c] for c in BASES] for b in BASES] for a in BASES])


@dataclass
class Segment:
    """An allele: its sequence with palindromic bases at the ends that may be trimmed, and the probability of each trim."""

    name: str
    cut: str
    #: V and J: by number of bases removed from ``cut``. D: by removed from the left and from the right.
    trim: np.ndarray

    @property
    def bases(self) -> np.ndarray:
        return np.array([_AT[b] for b in self.cut], int)


@dataclass
class Model:
    """``p_j``: by J, or by V and J. With D segments, ``p_d`` is by J and D, and ``ins`` holds the V-D and the D-J inserts, else one."""

    v: list[Segment]
    j: list[Segment]
    p_v: np.ndarray
    p_j: np.ndarray
    ins: list[np.ndarray]
    step: list[np.ndarray]
    d: list[Segment] = field(default_factory=list)
    p_d: np.ndarray | None = None
    #: Of each insert, the probabilities of its first letter; those that the transitions lead to, if not given.
    first: list[np.ndarray] | None = None

    def __post_init__(self) -> None:
        if self.first is None:
            self.first = [self._stationary(r) for r in self.step]

    @staticmethod
    def _stationary(r: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eig(r.T)
        x = np.real(vectors[:, np.argmin(np.abs(values - 1))])
        return x / x.sum()

    def joint(self) -> np.ndarray:
        """P(V, J)."""
        return self.p_v[:, None] * (self.p_j if self.p_j.ndim == 2 else self.p_j[None, :])


def palindrome(germline: str, left: int, right: int) -> str:
    """The germline with the reverse complements of its ends attached."""
    turn = str.maketrans("ACGT", "TGCA")
    return (germline[:left][::-1].translate(turn) if left else "") + germline + (germline[-right:][::-1].translate(turn) if right else "")


def masks(text: str, residues: bool, wild: str = "") -> list[np.ndarray]:
    """By position, which (last but one, last, new) bases may stand: shape 4, 4, 4. ``wild``: a letter for any residue but a stop."""
    out = []
    if not residues:
        for b in text.upper():
            m = np.zeros((4, 4, 4))
            m[:, :, _AT[b]] = 1
            out.append(m)
        return out
    for a in text:
        allowed = (_CODE != "*") if a == wild and wild else (_CODE == a)
        out += [np.ones((4, 4, 4)), np.ones((4, 4, 4)), allowed.astype(float)]
    return out


def degenerate_masks(pattern: str) -> list[np.ndarray]:
    """Masks of a residue pattern: letters, ``X`` for any residue, and sets in brackets."""
    import re

    out = []
    for one in re.findall(r"\[([A-Z*]+)\]|([A-Z*])", pattern):
        allowed = set(one[0] or one[1])
        ok = (_CODE != "*") if allowed == {"X"} else np.isin(_CODE, sorted(allowed))
        out += [np.ones((4, 4, 4)), np.ones((4, 4, 4)), ok.astype(float)]
    return out


def _forward(model: Model, ok: list[np.ndarray], vs: list[int], js: list[int]) -> float:
    n = len(ok)
    if not n:
        return 0.0
    can = np.stack(ok)  # position, last but one, last, new
    joint = model.joint()

    def fixed(state: np.ndarray, base: int) -> np.ndarray:
        """All positions go on by one given base: state and result end in position (0..n), last but one, last."""
        out = np.zeros_like(state)
        out[..., 1:, :, base] = (state[..., :-1, :, :] * can[:, :, :, base]).sum(axis=-2)
        return out

    def inserted(state: np.ndarray, k: int, backward: bool) -> np.ndarray:
        """All inserts after each position, by the transitions from the left, or from the right."""
        sizes, r, first = model.ins[k], model.step[k], model.first[k]
        out, now = sizes[0] * state, state
        for length in range(1, min(len(sizes), n + 1)):
            if length == 1:
                factor = np.ones((4, 4)) if backward else np.tile(first, (4, 1))
            else:
                factor = r.T if backward else r
            new = np.zeros_like(state)
            new[1:] = (now[:-1, :, :, None] * can).sum(axis=1) * factor
            now = new
            out = out + sizes[length] * (now * first[None, None, :] if backward else now)
        return out

    def started(v: int, weight: float) -> np.ndarray:
        """The states after each length of a V segment."""
        seg = model.v[v]
        state = np.zeros((n + 1, 4, 4))
        a = b = 0  # before the first two bases no codon is complete, so their predecessors don't matter
        for i, c in enumerate(seg.bases[:n]):
            if not can[i, a, b, c]:
                break
            a, b = b, c
            removed = len(seg.cut) - i - 1
            if removed < len(seg.trim):
                state[i + 1, a, b] += weight * seg.trim[removed]
        return state

    def ended(state: np.ndarray, j: int) -> float:
        """The weight of all ends by a J segment from each position on."""
        seg, total = model.j[j], 0.0
        bases, size = seg.bases, len(seg.cut)
        rest = np.ones((4, 4))  # by state, whether the segment may go on from a position to the end
        for length in range(1, min(size, n) + 1):
            at, c = n - length, bases[size - length]
            rest = can[at, :, :, c] * rest[None, :, c]
            if not rest.any():
                break
            removed = size - length
            if removed < len(seg.trim):
                total += seg.trim[removed] * float((state[at] * rest).sum())
        return total

    total = 0.0
    if not model.d:
        if model.p_j.ndim == 1:
            start = sum(started(v, model.p_v[v]) for v in vs)
            middle = inserted(start, 0, False)
            return sum(model.p_j[j] * ended(middle, j) for j in js)
        for v in vs:
            middle = inserted(started(v, 1.0), 0, False)
            total += sum(joint[v, j] * ended(middle, j) for j in js if joint[v, j])
        return total
    after_v = inserted(sum(started(v, model.p_v[v]) for v in vs), 0, False)
    after_d = []
    for seg in model.d:
        out, bases, size = np.zeros_like(after_v), seg.bases, len(seg.cut)
        now = np.zeros((0, *after_v.shape))  # by bases trimmed on the left
        for end in range(size + 1):
            if end:
                now = fixed(now, bases[end - 1])
            if end < seg.trim.shape[0]:
                now = np.concatenate([now, after_v[None]])
            right = size - end
            if right < seg.trim.shape[1]:
                out += np.tensordot(seg.trim[: len(now), right], now, 1)
        after_d.append(inserted(out, 1, True))
    for j in js:
        mixed = sum(model.p_d[j, d] * after_d[d] for d in range(len(model.d)))
        total += model.p_j[j] * ended(mixed, j)
    return total


def _named(segments: list[Segment], name: str | None) -> list[int]:
    """An allele by its name, the alleles of a gene, or all; an unknown name is an error."""
    if name is None:
        return list(range(len(segments)))
    exact = [i for i, s in enumerate(segments) if s.name == name]
    found = exact or [i for i, s in enumerate(segments) if s.name.split("*")[0] == name]
    if not found:
        raise KeyError(f"{name} is neither an allele of the model nor a gene of one")
    return found


def pgen_of(model: Model, text: str, residues: bool, v: str | None = None, j: str | None = None, wild: str = "") -> float:
    """The generation probability of one junction; residues beyond the twenty (and the wildcard) have none."""
    if residues and any(a not in RESIDUES and a != wild for a in text) or not residues and any(b not in _AT for b in text.upper()):
        return 0.0
    return _forward(model, masks(text, residues, wild), _named(model.v, v), _named(model.j, j))


def ball_of(model: Model, text: str, v: str | None = None, j: str | None = None) -> float:
    """The probability of a junction and of all that differ from it in one residue."""
    one = sum(pgen_of(model, text[:i] + "X" + text[i + 1 :], True, v, j, "X") for i in range(len(text)))
    return one - (len(text) - 1) * pgen_of(model, text, True, v, j)


def _scored(df: DataFrame, column: str, out: str, score, v: str | None, j: str | None) -> DataFrame:
    """``df`` with a probability for each row: each distinct junction (with its calls) is scored once."""
    keys = [column, *(c for c in (v, j) if c)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            calls = [batch[c] if c else [None] * len(batch) for c in (v, j)]
            yield batch.assign(**{out: [score(t, a, b) for t, a, b in zip(batch[column], *calls, strict=True)]})

    few = df.select(*keys).dropna().distinct()
    schema = ", ".join(f"`{k}` string" for k in keys) + f", `{out}` double"
    return df.join(few.mapInPandas(run, schema), keys, "left")


def pgen_nt(df: DataFrame, model: Model, column: str = "junction_nt", out: str = "pgen", *, v: str | None = None, j: str | None = None) -> DataFrame:
    """``df`` with the generation probability of nucleotide junctions, of all genes or of those named in columns ``v``, ``j``. Null junctions or calls have none."""
    from .scenarios import scenario_sums  # it is built on the model of this module

    return scenario_sums(df, model, column, out, v=v, j=j)


def pgen_aa(df: DataFrame, model: Model, column: str = "junction_aa", out: str = "pgen", *, v: str | None = None, j: str | None = None) -> DataFrame:
    """``df`` with the generation probability of residue junctions."""
    return _scored(df, column, out, lambda t, a, b: pgen_of(model, t, True, a, b), v, j)


def pgen_degenerate(df: DataFrame, model: Model, column: str = "pattern", out: str = "pgen", *, v: str | None = None, j: str | None = None) -> DataFrame:
    """``df`` with the probability of all junctions that fit a residue pattern (see :func:`degenerate_masks`)."""
    return _scored(df, column, out, lambda t, a, b: float(_forward(model, degenerate_masks(t), _named(model.v, a), _named(model.j, b))), v, j)


def pgen_ball(df: DataFrame, model: Model, column: str = "junction_aa", out: str = "pgen_ball", *, v: str | None = None, j: str | None = None) -> DataFrame:
    """``df`` with the probability of each junction and its neighbours by one residue."""
    return _scored(df, column, out, lambda t, a, b: ball_of(model, t, a, b), v, j)


def paired_pgen(paired: DataFrame, alpha: Model, beta: Model) -> DataFrame:
    """Paired chains with ``pgen_alpha``, ``pgen_beta`` and their product."""
    out = pgen_aa(pgen_aa(paired, alpha, "alpha_junction_aa", "pgen_alpha"), beta, "beta_junction_aa", "pgen_beta")
    return out.withColumn("pgen", F.col("pgen_alpha") * F.col("pgen_beta"))


def generate(spark: SparkSession, model: Model, n: int, *, seed: int = 0, productive: bool = False) -> DataFrame:
    """``n`` recombinations: ``id, v_call, j_call, junction_nt, junction_aa``; ``productive`` leaves out frame shifts and stops.

    Blocks of 10,000 are drawn each by its own seed, so the draws don't depend on how they are spread over tasks.
    """
    block = 10_000

    def draw(rng: np.random.Generator, size: int) -> list[tuple]:
        choose = lambda p: int(rng.choice(len(p), p=p / p.sum()))
        rows = []

        def insert(k: int, backward: bool) -> str:
            out: list[int] = []
            for _ in range(choose(model.ins[k])):
                out.append(choose(model.first[k] if not out else model.step[k][out[-1]]))
            text = "".join(BASES[b] for b in out)
            return text[::-1] if backward else text

        for _ in range(size):
            v = choose(model.p_v)
            j = choose(model.p_j[v] if model.p_j.ndim == 2 else model.p_j)
            sv, sj = model.v[v], model.j[j]
            left = sv.cut[: len(sv.cut) - choose(sv.trim[: len(sv.cut)])]
            right = sj.cut[choose(sj.trim[: len(sj.cut)]) :]
            if model.d:
                sd = model.d[choose(model.p_d[j])]
                cell = choose(sd.trim.ravel())
                a, b = divmod(cell, sd.trim.shape[1])
                middle = insert(0, False) + sd.cut[a : len(sd.cut) - b] + insert(1, True)
            else:
                middle = insert(0, False)
            rows.append((sv.name, sj.name, left + middle + right))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"]:
                rows = draw(np.random.default_rng([seed, int(at)]), min(block, n - int(at) * block))
                yield pd.DataFrame(rows, columns=["v_call", "j_call", "junction_nt"]).assign(id=int(at) * block + np.arange(len(rows)))[["id", "v_call", "j_call", "junction_nt"]]

    blocks = spark.range(-(-n // block))
    out = blocks.mapInPandas(run, "id long, v_call string, j_call string, junction_nt string").withColumn("junction_aa", translate(F.col("junction_nt")))
    return out.where("length(junction_nt) % 3 = 0 and not contains(junction_aa, '*')") if productive else out


def marginals_frame(spark: SparkSession, model: Model) -> DataFrame:
    """The model as one table: ``event, parent, value, weight`` (probability of the parent) and ``p`` (of the value given the parent)."""
    rows: list[tuple] = [("v", "", s.name, 1.0, float(p)) for s, p in zip(model.v, model.p_v, strict=True)]
    if model.p_j.ndim == 2:
        rows += [("j", s.name, t.name, float(model.p_v[a]), float(model.p_j[a, b])) for a, s in enumerate(model.v) for b, t in enumerate(model.j)]
    else:
        rows += [("j", "", t.name, 1.0, float(p)) for t, p in zip(model.j, model.p_j, strict=True)]
    of_j = model.joint().sum(axis=0)
    rows += [("v_trim", s.name, str(i), float(w), float(p)) for s, w in zip(model.v, model.p_v, strict=True) for i, p in enumerate(s.trim)]
    rows += [("j_trim", s.name, str(i), float(w), float(p)) for s, w in zip(model.j, of_j, strict=True) for i, p in enumerate(s.trim)]
    if model.d:
        rows += [("d", t.name, s.name, float(of_j[b]), float(model.p_d[b, a])) for b, t in enumerate(model.j) for a, s in enumerate(model.d)]
        of_d = of_j @ model.p_d
        rows += [("d_trim", s.name, f"{a},{b}", float(w), float(s.trim[a, b])) for s, w in zip(model.d, of_d, strict=True) for a in range(s.trim.shape[0]) for b in range(s.trim.shape[1])]
    for k, name in enumerate(("vd_ins", "dj_ins") if model.d else ("vj_ins",)):
        rows += [(name, "", str(i), 1.0, float(p)) for i, p in enumerate(model.ins[k])]
        rows += [(f"{name}_step", BASES[a], BASES[b], float(model.first[k][a]), float(model.step[k][a, b])) for a in range(4) for b in range(4)]
    return spark.createDataFrame(rows, "event string, parent string, value string, weight double, p double")


def gene_marginal(marginals: DataFrame, event: str) -> DataFrame:
    """``value, p``: the probabilities of an event's values over all parents."""
    return marginals.where(F.col("event") == event).groupBy("value").agg(F.sum(F.col("weight") * F.col("p")).alias("p"))


def entropy_table(marginals: DataFrame) -> DataFrame:
    """``event, entropy`` in bits: of each event given its parents. Inserts count what a letter adds, not how many there are."""
    bits = F.when(F.col("p") > 0, -F.col("weight") * F.col("p") * F.log2(F.when(F.col("p") > 0, F.col("p")))).otherwise(0.0)
    return marginals.groupBy("event").agg(F.sum(bits).alias("entropy"))


def total_entropy(marginals: DataFrame) -> DataFrame:
    """``entropy``: of a whole recombination; the letters of inserts as often as inserts are long on average."""
    size = marginals.where("event like '%\\_ins'").groupBy(F.concat("event", F.lit("_step")).alias("event")).agg(F.sum(F.col("p") * F.col("value").cast("double")).alias("size"))
    per = entropy_table(marginals).join(size, "event", "left")
    return per.agg(F.sum(F.col("entropy") * F.coalesce("size", F.lit(1.0))).alias("entropy"))


def mutual_information(marginals: DataFrame) -> DataFrame:
    """``event, information`` in bits between each event and its parent."""
    own = marginals.groupBy("event", "value").agg(F.sum(F.col("weight") * F.col("p")).alias("q"))
    x = marginals.where("weight * p > 0").join(own, ["event", "value"])
    return x.groupBy("event").agg(F.sum(F.col("weight") * F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("information"))


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """``event, js`` (bits) ``, tv``: distances of two models' tables, by parent, weighed by the parents' mean probability."""
    key = ["event", "parent", "value"]
    both = a.select(*key, F.col("p").alias("pa"), F.col("weight").alias("wa")).join(b.select(*key, F.col("p").alias("pb"), F.col("weight").alias("wb")), key, "full")
    both = both.fillna(0.0, ["pa", "pb"])
    of = Window.partitionBy("event", "parent")
    both = both.withColumns({f"w{s}": F.coalesce(F.max(f"w{s}").over(of), F.lit(0.0)) for s in "ab"})
    mid = (F.col("pa") + F.col("pb")) / 2
    half = lambda p: F.when(F.col(p) > 0, 0.5 * F.col(p) * F.log2(F.col(p) / F.when(mid > 0, mid))).otherwise(0.0)
    per = both.groupBy("event", "parent").agg(F.sum(half("pa") + half("pb")).alias("js"), (F.sum(F.abs(F.col("pa") - F.col("pb"))) / 2).alias("tv"), ((F.max("wa") + F.max("wb")) / 2).alias("w"))
    return per.groupBy("event").agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in ("js", "tv")))


def model_fit(df: DataFrame, pgen: str = "pgen") -> DataFrame:
    """``n, zero, log_likelihood`` (mean log10 of positive probabilities) of scored junctions."""
    p = F.col(pgen)
    return df.agg(F.count("*").alias("n"), F.count_if(p <= 0).alias("zero"), F.avg(F.when(p > 0, F.log10(F.when(p > 0, p)))).alias("log_likelihood"))


def pgen_spectrum(df: DataFrame, pgen: str = "pgen", width: float = 0.5) -> DataFrame:
    """``low, n``: how many junctions have each range of log10 probability."""
    p = F.col(pgen)
    return df.where(p > 0).groupBy((F.floor(F.log10(p) / width) * width).alias("low")).agg(F.count("*").alias("n"))


def compare_pgen(df: DataFrame, a: Model, b: Model, column: str = "junction_nt", *, labels: tuple[str, str] = ("a", "b"), residues: bool = False, v: str | None = None, j: str | None = None) -> DataFrame:
    """``df`` scored under two models: ``pgen_<a>, pgen_<b>``, ``log10_<a>, log10_<b>`` (null where a model gives no probability) and ``delta_log10``."""
    if labels[0] == labels[1]:
        raise ValueError(f"labels must differ, got {labels}")
    for model, x in zip((a, b), labels, strict=True):
        df = (pgen_aa if residues else pgen_nt)(df, model, column, f"pgen_{x}", v=v, j=j)
        p = F.col(f"pgen_{x}")
        df = df.withColumn(f"log10_{x}", F.when(p > 0, F.log10(F.when(p > 0, p))))
    return df.withColumn("delta_log10", F.col(f"log10_{labels[0]}") - F.col(f"log10_{labels[1]}"))


def pgen_summary(compared: DataFrame, *, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """One row about a table of :func:`compare_pgen`: how many rows each model and both can score, means, medians and quantiles of the logarithms and their
    difference, correlations, and the distance of the two distributions (its chance is asymptotic, and too small for paired scores). Null where there is nothing to measure."""
    scratch = Scratch(compared.sparkSession, "pgen-summary")
    x = scratch.cut(compared.select(*(F.col(f"log10_{c}").alias(k) for k, c in zip("ab", labels, strict=True)), F.col("delta_log10").alias("d")))
    ok = {k: F.col(k).isNotNull() for k in "ab"}
    both, first = ok["a"] & ok["b"], [F.count("*").alias("n"), *(F.count_if(ok[k]).alias(f"n_scoreable_{k}") for k in "ab")]
    means = [*(F.avg(k).alias(f"mean_log10_{k}") for k in "ab"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("sd_delta"), F.corr(F.when(both, F.col("a")), F.when(both, F.col("b"))).alias("pearson_log10")]
    row = x.agg(*first, F.count_if(both).alias("n_scoreable_both"), F.count_if(ok["a"] & ~ok["b"]).alias("only_a_scoreable"), F.count_if(ok["b"] & ~ok["a"]).alias("only_b_scoreable"), *means).first().asDict()
    for k in "ab":
        row[f"median_log10_{k}"] = (quantiles(scratch, x, k, [0.5]) or [None])[0]
    row["q05_delta"], row["median_delta"], row["q95_delta"] = quantiles(scratch, x, "d", [0.05, 0.5, 0.95]) or [None] * 3
    row["spearman_log10"] = spearman(scratch, x, "a", "b")
    row["ks_stat"], row["ks_p"] = kolmogorov_smirnov(scratch, x, "a", "b")
    scratch.close()
    kinds = ", ".join(f"{c} {'long' if c.startswith(('n', 'only')) else 'double'}" for c in row)
    return compared.sparkSession.createDataFrame([tuple(row.values())], kinds)


def usage_rescaled(model: Model, df: DataFrame) -> Model:
    """The model with the V and J usage of clonotypes: each votes once, an ambiguous call in equal parts among its genes; alleles share as before."""
    votes = {}
    for s in "vj":
        genes = F.array_distinct(F.transform(F.split(f"{s}_call", ","), lambda x: F.regexp_replace(F.trim(x), r"\*.*$", "")))
        shares = df.where(f"{s}_call is not null").select(genes.alias("g")).select(F.explode("g").alias("gene"), (1 / F.size("g")).alias("w")).groupBy("gene").agg(F.sum("w").alias("w"))
        votes[s] = {r["gene"]: r["w"] for r in shares.collect()}  # one row for each gene

    def spread(segments: list[Segment], old: np.ndarray, held: dict[str, float]) -> np.ndarray:
        gene = [s.name.split("*")[0] for s in segments]
        new = np.zeros(len(segments))
        for i, g in enumerate(gene):
            same = [k for k, h in enumerate(gene) if h == g]
            base = sum(old[k] for k in same)
            new[i] = held.get(g, 0.0) * (old[i] / base if base else 1 / len(same))
        return new / new.sum() if new.sum() else old

    p_v = spread(model.v, model.p_v, votes["v"])
    if model.p_j.ndim == 1:
        p_j = spread(model.j, model.p_j, votes["j"])
    else:
        p_j = np.array([spread(model.j, row, votes["j"]) for row in model.p_j])
    return Model(model.v, model.j, p_v, p_j, model.ins, model.step, model.d, model.p_d, model.first)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """The model as Parquet: its marginals, and the segments' sequences."""
    marginals_frame(spark, model).coalesce(1).write.parquet(f"{path}/marginals")
    rows = [(kind, i, s.name, s.cut) for kind, segments in (("v", model.v), ("d", model.d), ("j", model.j)) for i, s in enumerate(segments)]
    spark.createDataFrame(rows, "kind string, at int, name string, cut string").coalesce(1).write.parquet(f"{path}/segments")


def load_model(spark: SparkSession, path: str) -> Model:
    """A saved model; its tables are small and are read on the driver."""
    cuts: dict[str, list] = {"v": [], "d": [], "j": []}
    for r in spark.read.parquet(f"{path}/segments").orderBy("kind", "at").collect():
        cuts[r["kind"]].append((r["name"], r["cut"]))
    rows = spark.read.parquet(f"{path}/marginals").collect()
    p = {(r["event"], r["parent"], r["value"]): r["p"] for r in rows}
    weight = {(r["event"], r["parent"]): r["weight"] for r in rows}
    listed = lambda event, parent: np.array([x for _, x in sorted((int(k[2]), x) for k, x in p.items() if k[0] == event and k[1] == parent)])

    def joint(name: str) -> np.ndarray:
        cells = [(tuple(map(int, k[2].split(","))), x) for k, x in p.items() if k[0] == "d_trim" and k[1] == name]
        out = np.zeros(tuple(np.max([c for c, _ in cells], axis=0) + 1))
        for c, x in cells:
            out[c] = x
        return out

    v, j = ([Segment(n, c, listed(f"{s}_trim", n)) for n, c in cuts[s]] for s in "vj")
    d = [Segment(n, c, joint(n)) for n, c in cuts["d"]]
    p_v = np.array([p["v", "", s.name] for s in v])
    p_j = np.array([p["j", "", t.name] for t in j]) if d or ("j", "", j[0].name) in p else np.array([[p["j", s.name, t.name] for t in j] for s in v])
    names = ("vd_ins", "dj_ins") if d else ("vj_ins",)
    step = [np.array([[p[f"{n}_step", a, b] for b in BASES] for a in BASES]) for n in names]
    first = [np.array([weight[f"{n}_step", a] for a in BASES]) for n in names]
    return Model(v, j, p_v, p_j, [listed(n, "") for n in names], step, d, np.array([[p["d", t.name, s.name] for s in d] for t in j]) if d else None, first)


def check_model(model: Model) -> list[str]:
    """What is wrong with a model: probabilities that don't sum to 1, trims beyond a segment."""
    out = [f"p_v sums to {model.p_v.sum():.6f}"] if abs(model.p_v.sum() - 1) > 1e-6 else []
    out += [f"p_j sums to {x:.6f}" for x in np.atleast_1d(model.p_j.sum(axis=-1)) if abs(x - 1) > 1e-6]
    for kind, segments in (("v", model.v), ("j", model.j)):
        for s in segments:
            if abs(s.trim.sum() - 1) > 1e-6:
                out.append(f"{kind} {s.name}: trims sum to {s.trim.sum():.6f}")
            if s.trim[len(s.cut) :].sum() > 0:
                out.append(f"{kind} {s.name}: trims beyond the segment")
    out += [f"inserts sum to {x.sum():.6f}" for x in model.ins if abs(x.sum() - 1) > 1e-6]
    return out


def read_model(folder: str, functions: tuple[str, ...] | None = None) -> Model:
    """A model in the common text form: ``model_params.txt``, ``model_marginals.txt`` and the anchors of V and J genes (CSV), on the driver: some ten thousand numbers.

    Trims are listed from the longest palindrome (negative numbers of deletions) on; realisations stand in the order of their index.
    ``functions``: only genes whose anchors have one of these functional classes; what the others had is not shared out.
    """
    import csv
    import os
    import re

    def lines(name: str) -> list[str]:
        with open(os.path.join(folder, name)) as f:
            return [x.rstrip("\n") for x in f]

    events: dict[str, dict[int, list[str]]] = {}
    name, section = None, ""
    for x in lines("model_params.txt"):
        if x.startswith("@"):
            section = x
        elif section != "@Event_list":
            continue
        elif x.startswith("#"):
            head = x[1:].split(";")
            name = f"{head[0]}:{head[1]}:{head[2]}"
            events[name] = {}
        elif x.startswith("%") and name:
            parts = x[1:].split(";")
            events[name][int(parts[-1])] = [p.strip() for p in parts[:-1]]
    pick = lambda *words: next(([v for _, v in sorted(e.items())] for k, e in events.items() if all(w in k for w in words)), None)
    values: dict[str, np.ndarray] = {}
    name, shape, flat = None, (), []

    def close() -> None:
        if name is not None:
            values[name] = np.array(flat, float).reshape(shape)

    for x in lines("model_marginals.txt"):
        if x.startswith("@"):
            close()
            name, flat = x[1:], []
        elif x.startswith("$Dim"):
            shape = tuple(map(int, re.findall(r"\d+", x)))
        elif x.startswith("%"):
            flat += [float(v) for v in x[1:].split(",")]
    close()
    anchors = {}
    for s in "VJ":
        path = next((p for p in (f"{s}_gene_CDR3_anchors.csv", f"{s}_gene_CDR3_anchors.tsv") if os.path.exists(os.path.join(folder, p))), None)
        with open(os.path.join(folder, path)) as f:
            anchors[s] = {r["gene"]: int(r["anchor_index"]) for r in csv.DictReader(f) if functions is None or r.get("function") in functions}

    def trims(*words: str) -> tuple[int, np.ndarray]:
        """The longest palindrome, and the place of each number of removed bases in the table."""
        sizes = [int(v[0]) for v in pick(*words)]
        most = -min(sizes)
        return most, np.array([sizes.index(k) for k in sorted(sizes)])

    def normal(x: np.ndarray) -> np.ndarray:
        total = x.sum(axis=-1, keepdims=True)
        return np.divide(x, total, out=np.full_like(x, 1 / x.shape[-1]), where=total > 0)

    vp, vo = trims("Deletion", "V_gene", "Three_prime")
    jp, jo = trims("Deletion", "J_gene", "Five_prime")
    v, j, keep_v, keep_j = [], [], [], []
    for i, (gene, full) in enumerate(pick("GeneChoice", "V_gene")):
        if gene in anchors["V"]:
            keep_v.append(i)
            v.append(Segment(gene, palindrome(full[anchors["V"][gene] :], 0, vp), normal(values["v_3_del"][i][vo])))
    for i, (gene, full) in enumerate(pick("GeneChoice", "J_gene")):
        if gene in anchors["J"]:
            keep_j.append(i)
            j.append(Segment(gene, palindrome(full[: anchors["J"][gene] + 3], jp, 0), normal(values["j_5_del"][i][jo])))
    p_v, p_j = values["v_choice"][keep_v], values["j_choice"]
    p_j = p_j[np.ix_(keep_v, keep_j)] if p_j.ndim == 2 else p_j[keep_j]
    steps = lambda k: normal(values[k].reshape(4, 4))
    if pick("GeneChoice", "D_gene") is None:
        return Model(v, j, p_v, p_j, [normal(values["vj_ins"])], [steps("vj_dinucl")])
    (lp, lo), (rp, ro) = trims("Deletion", "D_gene", "Five_prime"), trims("Deletion", "D_gene", "Three_prime")
    d = []
    for i, (gene, full) in enumerate(pick("GeneChoice", "D_gene")):
        joint = values["d_5_del"][i][lo][:, None] * values["d_3_del"][i][np.ix_(lo, ro)]
        d.append(Segment(gene, palindrome(full, lp, rp), joint / joint.sum()))
    return Model(v, j, p_v, p_j, [normal(values["vd_ins"]), normal(values["dj_ins"])], [steps("vd_dinucl"), steps("dj_dinucl")], d, normal(values["d_gene"][keep_j]))
