"""Recombination scenarios of nucleotide junctions as tables: total and best scenarios, expected counts, and models fitted to junctions.

A model becomes a table of pieces: what a trimmed V begins a junction with, what a trimmed J ends it with, what a trimmed D is, each with its weight. A
junction becomes the rows of its beginnings, ends and spans. One join by text finds the weights, one grouping by junction brings them together,
by position; the inserts between positions follow from running sums of log transitions. All that is held of a junction are arrays as long as it is,
and all of it are built-in column functions: sums over scenarios, maxima with what reaches them, and the expected use of every piece.

What links the two sides of a junction is the D segment, or in models without D segments the V allele, as J depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .recombination import BASES, Model, Segment, load_model, save_model

#: Pieces are broadcast up to so many; a larger table is joined by shuffling.
BROADCAST = 200_000
#: The logarithm of a transition that has no probability.
NEVER = -1e4


def links(model: Model) -> int:
    return len(model.d) if model.d else len(model.v) if model.p_j.ndim == 2 else 1


def _entries(model: Model) -> Iterator[tuple[str, str, str, int, float, tuple[int, int, int]]]:
    """``kind, allele, text, link, weight, what``: all trimmed segments. What: the allele's number, and bases removed (D: on the left and on the right)."""
    joint = not model.d and model.p_j.ndim == 2
    for i, s in enumerate(model.v):
        for removed, w in enumerate(s.trim[: len(s.cut)]):
            if w * model.p_v[i] > 0:
                yield "v", s.name, s.cut[: len(s.cut) - removed], i if joint else 0, float(w * model.p_v[i]), (i, removed, 0)
    for j, s in enumerate(model.j):
        of = model.p_j[j] * model.p_d[j] if model.d else model.p_j[:, j] if joint else model.p_j[[j]]
        for removed, w in enumerate(s.trim[: len(s.cut)]):
            for g, p in enumerate(of):
                if w * p > 0:
                    yield "j", s.name, s.cut[removed:], g, float(w * p), (j, removed, 0)
    for g, s in enumerate(model.d):
        for a in range(min(s.trim.shape[0], len(s.cut) + 1)):
            for b in range(min(s.trim.shape[1], len(s.cut) - a + 1)):
                if s.trim[a, b] > 0:
                    yield "d", "", s.cut[a : len(s.cut) - b], g, float(s.trim[a, b]), (g, a, b)


def _pieces(spark: SparkSession, model: Model, named: bool, best: bool) -> DataFrame:
    """``kind, call, piece, w``: by link, the total weight of a text, or ``best``: the largest with what it is of. ``call`` is empty for all alleles, or an allele's or gene's name."""
    held: dict[tuple[str, str, str], list] = {}
    for kind, name, text, g, w, what in _entries(model):
        for call in {"", name, name.split("*")[0]} if named and name else {""}:
            cell = held.setdefault((kind, call, text), [(0.0, -1, -1, -1)] * links(model) if best else [0.0] * links(model))
            cell[g] = max(cell[g], (w, *what)) if best else cell[g] + w
    cell_type = "array<struct<w: double, of: int, left: int, right: int>>" if best else "array<double>"
    rows = [(*key, cell) for key, cell in held.items()]
    out = spark.createDataFrame(rows, f"kind string, call string, piece string, w {cell_type}")
    return F.broadcast(out) if len(rows) * links(model) <= BROADCAST else out


def _numbers(x: np.ndarray) -> Column:
    return F.lit([float(v) for v in x])


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class _Junctions:
    """Distinct junctions (with their calls) and the pieces that occur in them, by position."""

    def __init__(self, df: DataFrame, model: Model, column: str, v: str | None, j: str | None, best: bool = False) -> None:
        self.model, self.g = model, links(model)
        spark = df.sparkSession
        given = df.select(F.col(column).alias("s"), F.col(v).alias("v") if v else F.lit("").alias("v"), F.col(j).alias("j") if j else F.lit("").alias("j"))
        self.known = given.dropna().groupBy("s", "v", "j").agg(F.count("*").alias("copies"))
        most = {k: max((len(s.cut) for s in segments), default=0) for k, segments in (("v", model.v), ("j", model.j), ("d", model.d))}
        longest = sum(most.values()) + sum(len(x) - 1 for x in model.ins)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes: not to be merged into fewer tasks
        base = self.known.repartition(tasks, "s", "v", "j").withColumn("n", F.length("s")).withColumn("text", F.upper("s")).where(f"n between 2 and {longest} and text rlike '^[ACGT]+$'")
        for call, segments in (("v", model.v), ("j", model.j)):
            names = sorted({"", *(x for s in segments for x in (s.name, s.name.split("*")[0]))})
            known = F.col(call).isin(names)
            base = base.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.col(call), F.lit(" is neither an allele of the model nor a gene of one"))).cast("boolean")))
        # Step -2: what a V can begin it with, -1: what a J can end it with, from 0: what a D from there on can be.
        ends = f"case i when -2 then sequence(1, least(n, {most['v']})) when -1 then sequence(greatest(0, n - {most['j']}), n - 1) else sequence(i, least(n, i + {most['d']})) end"
        steps = base.withColumn("i", F.explode(F.expr("sequence(-2, n)" if model.d else "sequence(-2, -1)"))).withColumn("k", F.explode(F.expr(ends)))
        rows = steps.selectExpr("s", "v", "j", "copies", "case i when -2 then 'v' when -1 then 'j' else 'd' end as kind", "case i when -2 then v when -1 then j else '' end as call", "if(i < 0, k, i) as a", "if(i < 0, 0, k) as b", "case i when -2 then substring(text, 1, k) when -1 then substring(text, k + 1) else substring(text, i + 1, k - i) end as piece")
        found = rows.join(_pieces(spark, model, bool(v or j), best), ["kind", "call", "piece"])
        lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("a", "b", "w")))).alias(f"of_{kind}") for kind in "vjd"]
        held = found.groupBy("s", "v", "j", "copies").agg(*lists).where("size(of_v) > 0 and size(of_j) > 0" + (" and size(of_d) > 0" if model.d else ""))
        for k, r in enumerate(model.step):
            logs = np.full(16, NEVER)
            positive = r.ravel() > 0
            logs[positive] = np.log(r.ravel()[positive])
            held = held.withColumns({f"ins{k}": _numbers(model.ins[k]), f"first{k}": _numbers(model.first[k]), f"logs{k}": _numbers(logs)})
        self.held = held.withColumn("n", F.length("s"))

    def insert(self, k: int, a: str, b: str) -> str:
        """SQL: the probability of the insert between positions ``a`` and ``b``."""
        first = a if k == 0 else f"{b} - 1"
        return f"case when {b} < {a} or {b} - {a} >= {len(self.model.ins[k])} then 0D when {b} = {a} then ins{k}[0] else ins{k}[{b} - {a}] * element_at(first{k}, c[{first}]) * exp(run{k}[{b} - 1] - run{k}[{a}]) end"

    def within(self, body: str) -> str:
        """SQL: ``body`` with the numbers of the letters ``c`` and the running sums ``run0``, ``run1`` of log transitions."""
        for k in reversed(range(len(self.model.step))):
            pair = "4 * c[i - 2] + c[i - 1] - 4" if k == 0 else "4 * c[i - 1] + c[i - 2] - 4"  # the second insert is drawn from its right end
            body = let(f"run{k}", f"aggregate(sequence(1, n), cast(array() as array<double>), (acc, i) -> array_append(acc, if(i = 1, 0D, element_at(acc, -1) + element_at(logs{k}, {pair}))))", body)
        return let("c", "transform(sequence(1, n), i -> locate(upper(substring(s, i, 1)), 'ACGT'))", body)

    def around(self, body: str) -> str:
        """With D segments, also ``before``: by position, the weight of all that can stand before a D; and ``after``: by position and D, of all that can stand behind."""
        before = f"transform(sequence(0, n), p -> aggregate(of_v, 0D, (acc, e) -> acc + e.w[0] * {self.insert(0, 'e.a', 'p')}))"
        each = f"transform(sequence(0, {self.g - 1}), g -> aggregate(sequence(0, size(of_j) - 1), 0D, (acc, i) -> acc + f[i] * of_j[i].w[g]))"
        after = "transform(sequence(0, n), p -> " + let("f", f"transform(of_j, e -> {self.insert(1, 'p', 'e.a')})", each) + ")"
        return self.within(let("before", before, let("after", after, body)))

    def total(self) -> str:
        """SQL: the sum over all scenarios."""
        if self.model.d:
            return self.around(f"aggregate(of_d, 0D, (acc, e) -> acc + before[e.a] * aggregate(sequence(0, {self.g - 1}), 0D, (t, g) -> t + e.w[g] * after[e.b][g]))")
        dot = "aggregate(zip_with(x.w, y.w, (q, r) -> q * r), 0D, (t, q) -> t + q)"
        return self.within(f"aggregate(of_v, 0D, (acc, x) -> acc + aggregate(of_j, 0D, (u, y) -> u + if(y.a >= x.a and y.a - x.a < {len(self.model.ins[0])}, {dot} * {self.insert(0, 'x.a', 'y.a')}, 0D)))")

    def shares(self) -> str:
        """SQL: an array of ``kind, piece, g, a, b, x``: the expected use of each piece by link, and of each insert (kinds 0 and 1, from ``a`` to ``b``), given the junction."""
        each_g, ins = f"sequence(0, {self.g - 1})", [len(x) for x in self.model.ins]
        item = lambda kind, piece, g, a, b, x: f"struct('{kind}' as kind, {piece} as piece, {g} as g, {a} as a, {b} as b, {x} * unit as x)"
        unit = "if(whole > 0D, 1D / whole, 0D)"
        begins, ends = "substring(s, 1, x.a)", "substring(s, y.a + 1)"
        if not self.model.d:
            in_reach = f"filter(of_j, y -> y.a >= x.a and y.a - x.a < {ins[0]})"
            dot = "aggregate(zip_with(x.w, y.w, (q, r) -> q * r), 0D, (t, q) -> t + q)"
            of_v = item("v", begins, "g", 0, 0, f"x.w[g] * aggregate(of_j, 0D, (t, y) -> t + {self.insert(0, 'x.a', 'y.a')} * y.w[g])")
            of_j = item("j", ends, "g", 0, 0, f"y.w[g] * aggregate(of_v, 0D, (t, x) -> t + {self.insert(0, 'x.a', 'y.a')} * x.w[g])")
            parts = [f"flatten(transform(of_v, x -> transform({each_g}, g -> {of_v})))", f"flatten(transform(of_j, y -> transform({each_g}, g -> {of_j})))", f"flatten(transform(of_v, x -> transform({in_reach}, y -> {item('0', chr(39) * 2, 0, 'x.a', 'y.a', dot + ' * ' + self.insert(0, 'x.a', 'y.a'))})))"]
            return let("whole", self.total(), let("unit", unit, self.within(f"concat(array(struct('fit' as kind, '' as piece, 0 as g, 0 as a, 0 as b, whole as x)), {', '.join(parts)})")))
        rest = f"transform(sequence(0, n), p -> aggregate(filter(of_d, e -> e.a = p), 0D, (t, e) -> t + aggregate({each_g}, 0D, (u, g) -> u + e.w[g] * after[e.b][g])))"
        upto = f"transform(sequence(0, n), p -> {let('here', 'filter(of_d, e -> e.b = p)', f'transform({each_g}, g -> aggregate(here, 0D, (t, e) -> t + before[e.a] * e.w[g]))')})"
        of_v = item("v", begins, 0, 0, 0, f"x.w[0] * aggregate(sequence(0, n), 0D, (t, p) -> t + {self.insert(0, 'x.a', 'p')} * rest[p])")
        first = item("0", "''", 0, "x.a", "p", f"x.w[0] * {self.insert(0, 'x.a', 'p')} * rest[p]")
        of_j = item("j", ends, "g", 0, 0, f"y.w[g] * aggregate(sequence(0, n), 0D, (t, p) -> t + {self.insert(1, 'p', 'y.a')} * upto[p][g])")
        second = item("1", "''", 0, "p", "y.a", f"{self.insert(1, 'p', 'y.a')} * aggregate({each_g}, 0D, (t, g) -> t + upto[p][g] * y.w[g])")
        of_d = item("d", "substring(s, e.a + 1, e.b - e.a)", "g", 0, 0, "before[e.a] * e.w[g] * after[e.b][g]")
        parts = [f"transform(of_v, x -> {of_v})", f"flatten(transform(of_j, y -> transform({each_g}, g -> {of_j})))", f"flatten(transform(of_d, e -> transform({each_g}, g -> {of_d})))"]
        parts += [f"flatten(transform(of_v, x -> transform(sequence(x.a, least(n, x.a + {ins[0] - 1})), p -> {first})))", f"flatten(transform(of_j, y -> transform(sequence(greatest(0, y.a - {ins[1] - 1}), y.a), p -> {second})))"]
        whole = "aggregate(sequence(0, n), 0D, (t, p) -> t + before[p] * rest[p])"
        return self.around(let("rest", rest, let("upto", upto, let("whole", whole, let("unit", unit, f"concat(array(struct('fit' as kind, '' as piece, 0 as g, 0 as a, 0 as b, whole as x)), {', '.join(parts)})")))))


def scenario_sums(df: DataFrame, model: Model, column: str = "junction_nt", out: str = "pgen", *, v: str | None = None, j: str | None = None) -> DataFrame:
    """``df`` with the generation probability of nucleotide junctions: the sum over all scenarios, of all genes or of those named in columns ``v``, ``j``.

    Null junctions or calls have none; junctions with other letters than ACGT, and those no scenario gives, have 0. A call that the model doesn't know is an error.
    """
    junctions = _Junctions(df, model, column, v, j)
    keys = [column, *(c for c in (v, j) if c)]
    sums = junctions.held.select("s", "v", "j", F.expr(junctions.total()).alias("p"))
    of = lambda x: x.select(F.col("s").alias(column), *([F.col("v").alias(v)] if v else []), *([F.col("j").alias(j)] if j else []), *([F.col("p")] if "p" in x.columns else []))
    known = of(junctions.known).join(of(sums), keys, "left").select(*keys, F.coalesce("p", F.lit(0.0)).alias(out))
    return df.join(known, keys, "left")


def best_scenarios(df: DataFrame, model: Model, column: str = "junction_nt", *, v: str | None = None, j: str | None = None) -> DataFrame:
    """The most likely scenario of each distinct junction (with its calls): ``s, v, j`` (junction and calls as given), ``v_call, d_call, j_call``, where the V ends,
    the D starts and ends and the J starts (``v_end, d_start, d_end, j_start``), bases removed (``v_trim, d_trim_left, d_trim_right, j_trim``), and its probability ``p``.

    Junctions that no scenario gives have no row. Of equally likely scenarios the one with the later positions and higher numbers is taken.
    """
    junctions = _Junctions(df, model, column, v, j, best=True)
    held, g = junctions.held, junctions.g
    names = {k: F.lit([s.name for s in segments]) for k, segments in (("v", model.v), ("j", model.j), ("d", model.d)) if segments}
    if model.d:
        before = f"transform(sequence(0, n), p -> array_max(transform(of_v, e -> struct(e.w[0].w * {junctions.insert(0, 'e.a', 'p')} as w, e.a as at, e.w[0].of as of, e.w[0].left as cut))))"
        each = f"transform(sequence(0, {g - 1}), g -> array_max(transform(sequence(0, size(of_j) - 1), i -> struct(f[i] * of_j[i].w[g].w as w, of_j[i].a as at, of_j[i].w[g].of as of, of_j[i].w[g].left as cut))))"
        after = "transform(sequence(0, n), p -> " + let("f", f"transform(of_j, e -> {junctions.insert(1, 'p', 'e.a')})", each) + ")"
        top = f"array_max(transform(of_d, e -> array_max(transform(sequence(0, {g - 1}), g -> struct(before[e.a].w * e.w[g].w * after[e.b][g].w as p, before[e.a] as v, struct(e.a as start, e.b as stop, e.w[g].of as of, e.w[g].left as cut, e.w[g].right as cut_right) as d, after[e.b][g] as j)))))"
        top = let("before", before, let("after", after, top))
    else:
        pair = f"transform(sequence(0, {g - 1}), g -> struct(x.w[g].w * y.w[g].w * {junctions.insert(0, 'x.a', 'y.a')} as p, struct(x.w[g].w as w, x.a as at, x.w[g].of as of, x.w[g].left as cut) as v, struct(y.w[g].w as w, y.a as at, y.w[g].of as of, y.w[g].left as cut) as j))"
        top = f"array_max(flatten(transform(of_v, x -> transform(filter(of_j, y -> y.a >= x.a and y.a - x.a < {len(model.ins[0])}), y -> array_max({pair})))))"
    found = held.select("s", "v", "j", F.expr(junctions.within(top)).alias("t")).where("t.p > 0")
    name = lambda k: F.element_at(names[k], F.col(f"t.{k}.of") + 1).alias(f"{k}_call")
    none = F.lit(None).cast("int")
    of_d = [F.col(f"t.d.{x}").alias(y) if model.d else none.alias(y) for x, y in (("start", "d_start"), ("stop", "d_end"), ("cut", "d_trim_left"), ("cut_right", "d_trim_right"))]
    return found.select("s", "v", "j", name("v"), name("d") if model.d else F.lit(None).cast("string").alias("d_call"), name("j"), F.col("t.v.at").alias("v_end"), *of_d[:2], F.col("t.j.at").alias("j_start"), F.col("t.v.cut").alias("v_trim"), *of_d[2:], F.col("t.j.cut").alias("j_trim"), F.col("t.p").alias("p"))


def expected_counts(df: DataFrame, model: Model, column: str = "junction_nt", *, v: str | None = None, j: str | None = None) -> DataFrame:
    """``kind, piece, g, x``: how often each part of the model is expected in the scenarios of these junctions, each row of ``df`` counting once.

    Kinds: ``v``, ``d`` and ``j`` (a trimmed segment's text, by link), and by insert k ``len<k>`` (its length), ``first<k>`` (its first letter, as
    drawn) and ``step<k>`` (two letters that follow); ``fit``: the junctions that have a scenario (``n``) and the sum of the logarithms of their probabilities
    (``log``). As many rows as the model has parts, whatever the number of junctions.
    """
    junctions = _Junctions(df.withColumn(column, F.upper(column)), model, column, v, j)
    rows = junctions.held.select("s", "copies", F.explode(F.expr(junctions.shares())).alias("e")).select("s", "copies", "e.*").where("x > 0")
    letter = """case when kind = '0' and i = a or kind = '1' and i = b - 1 then struct(concat('first', kind) as kind, substring(s, i + 1, 1) as piece)
        else struct(concat('step', kind) as kind, concat(substring(s, if(kind = '0', i, i + 2), 1), substring(s, i + 1, 1)) as piece) end"""
    each = f"""case when kind in ('0', '1') then concat(array(struct(concat('len', kind) as kind, string(b - a) as piece)), if(b > a, transform(sequence(a, b - 1), i -> {letter}), array()))
        when kind = 'fit' then array(struct(kind, 'n' as piece), struct(kind, 'log' as piece)) else array(struct(kind, piece)) end"""
    parts = rows.select("copies", "g", "x", F.explode(F.expr(each)).alias("part")).select("copies", "g", "x", "part.kind", "part.piece")
    value = F.when(F.col("kind") != "fit", F.col("x")).when(F.col("piece") == "n", F.lit(1.0)).otherwise(F.log("x"))
    return parts.groupBy("kind", "piece", "g").agg(F.sum(value * F.col("copies")).alias("x"))


def refitted(model: Model, counts: dict[tuple[str, str, int], float]) -> Model:
    """The model whose probabilities are the shares of these expected counts (by kind, piece and link); what was never expected keeps its distribution, if it has one of its own."""
    share = lambda x, old: x / x.sum() if x.sum() > 0 else old
    totals: dict[tuple[str, str, int], float] = {}
    entries = list(_entries(model))
    for kind, _, text, g, w, _ in entries:
        totals[kind, text, g] = totals.get((kind, text, g), 0.0) + w
    of_v, of_j, of_d = ([np.zeros_like(s.trim, dtype=float) for s in segments] for segments in (model.v, model.j, model.d))
    pairs = np.zeros((len(model.j), links(model)))
    for kind, _, text, g, w, (i, a, b) in entries:
        x = counts.get((kind, text, g), 0.0) * w / totals[kind, text, g]
        if kind == "v":
            of_v[i][a] += x
        elif kind == "d":
            of_d[i][a, b] += x
        else:
            of_j[i][a] += x
            pairs[i, g] += x
    renewed = lambda segments, of: [Segment(s.name, s.cut, share(x, s.trim)) for s, x in zip(segments, of, strict=True)]
    p_v = share(np.array([x.sum() for x in of_v]), model.p_v)
    if model.d or model.p_j.ndim == 1:
        p_j = share(pairs.sum(axis=1), model.p_j)
    else:
        p_j = np.array([share(x, old) for x, old in zip(pairs.T, model.p_j, strict=True)])
    p_d = np.array([share(x, old) for x, old in zip(pairs, model.p_d, strict=True)]) if model.d else None
    of = lambda kind, *pieces: np.array([counts.get((kind, x, 0), 0.0) for x in pieces])
    ins = [share(of(f"len{k}", *map(str, range(len(x)))), x) for k, x in enumerate(model.ins)]
    step = [np.array([share(of(f"step{k}", *(a + b for b in BASES)), r[i]) for i, a in enumerate(BASES)]) for k, r in enumerate(model.step)]
    first = [share(of(f"first{k}", *BASES), x) for k, x in enumerate(model.first)]
    return Model(renewed(model.v, of_v), renewed(model.j, of_j), p_v, p_j, ins, step, renewed(model.d, of_d), p_d, first)


def infer(df: DataFrame, model: Model, column: str = "junction_nt", *, v: str | None = None, j: str | None = None, rounds: int = 20, tolerance: float = 1e-4, path: str | None = None) -> tuple[Model, list[float]]:
    """A model fitted to junctions by expectation maximisation from ``model`` on, and the mean log likelihood before each round.

    Every row counts once; out-of-frame junctions are what a model of recombination should be fitted to. Junctions without a scenario take no part. Ends after ``rounds``, or when
    the likelihood gains less than ``tolerance``. ``path``: every round's model is saved there, and a second call goes on after the last one that is complete. Null junctions
    or calls are left out; no usable junction leaves the model as it is.
    """
    spark, history, begun = df.sparkSession, [], 0
    if path:
        done = _rounds(spark, path)
        if done:
            model, history, begun = load_model(spark, f"{path}/{done[-1]}"), [_fit(spark, f"{path}/{k}") for k in done], done[-1] + 1
    for k in range(begun, rounds):
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        counts = {(r["kind"], r["piece"], r["g"]): r["x"] for r in expected_counts(df, model, column, v=v, j=j).collect()}  # as many rows as the model has parts
        n = counts.get(("fit", "n", 0), 0.0)
        if not n:
            break
        history.append(counts["fit", "log", 0] / n)
        model = refitted(model, counts)
        if path:
            save_model(spark, model, f"{path}/{k}")
            spark.createDataFrame([(history[-1],)], "fit double").coalesce(1).write.parquet(f"{path}/{k}/fit")  # last: a round with it is complete
    return model, history


def _fit(spark: SparkSession, path: str) -> float:
    return spark.read.parquet(f"{path}/fit").first()["fit"]


def _rounds(spark: SparkSession, path: str) -> list[int]:
    """The rounds that are complete; what an interrupted one left is deleted."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found, done = sorted(int(x.getPath().getName()) for x in files.listStatus(folder) if x.getPath().getName().isdigit()), []
    for k in found:
        whole = files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{k}/fit/_SUCCESS"))
        if whole and k == len(done):
            done.append(k)
        else:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{k}"), True)
    return done
