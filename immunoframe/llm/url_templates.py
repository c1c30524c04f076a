"""URL filters by a path-template tree.

Per host, the distinct URL paths form a tree of segments. From the root down, a node whose children are new too
often to be sections is variable: its children become wildcards of their shape (``{n}``, ``{n}.html``, ``{w}``), and
what lies below them is judged together. From the deepest level up, branches of one node that lead to
statistically like shapes and whose labelled shares of bad URLs are alike (both against the node's largest branch
of their kind, mostly bad or not) are merged to ``*`` and that one's name; a branch without labels of its own is merged with nothing. Each template
then has a purity, the smoothed share of bad URLs among its labelled ones, and templates whose purity is surely
bad enough are rejected. All tests are of shares with their confidence bounds, none of a number of rows.

Fixed rules (host and path prefix, allow or block) come before the tree; URLs that a rule decides are the
labelled ones if no other labels are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rules by contract: where they hold and what they say.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: A node is variable if its children are surely (by so many deviations) more than this share of its distinct paths.
NEW, SURE = 0.2, 3.0
#: Rates of two branches are alike if they differ by no more than SURE deviations and that is at most so much.
ALIKE = 0.5
#: Smoothing: weight of the prior share, and the prior; a template is rejected if its purity less DEVIATIONS is at least PURITY.
WEIGHT, PRIOR, PURITY, DEVIATIONS = 5.0, 0.3, 0.85, 1.64


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s:.*?)://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s:.*?)://[^/?#]*", ""))
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    extension = F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})$", 1)
    kind = F.when(segment.rlike(r"^[0-9]+(?:\.[A-Za-z0-9]{1,5})?$"), F.lit("{n}")).when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F\-]{8,}(?:\.[A-Za-z0-9]{1,5})?$"), F.lit("{h}")).otherwise(F.lit("{w}"))
    return F.concat(kind, extension)


def _joined(steps: Column) -> Column:
    return F.array_join(steps, "")


def _nodes(paths: DataFrame, start: Column) -> DataFrame:
    """A row for each path and each of its levels from ``start`` on: the node there by ``level, a, b`` (hashes of the steps before), and the ``step`` that leaves it."""

    def node(i: Column) -> Column:
        before = F.slice("steps", F.lit(1), i)
        return F.struct(i.alias("level"), F.xxhash64(before).alias("a"), F.xxhash64(F.lit(29), before).alias("b"), F.get("steps", i).alias("step"))

    there = F.filter(F.sequence(F.lit(0), F.size("steps")), lambda i: (i >= start) & (i < F.size("steps")))
    return paths.withColumn("at", F.explode(F.transform(there, node))).select(*(c for c in paths.columns if c != "steps"), "at.*")


def _tree(scratch: Scratch, paths: DataFrame) -> DataFrame:
    """``paths`` with ``steps``, their segments or wildcards.

    In a round all nodes are judged, and each path takes the wildcard of its first variable node at or below ``done``; all nodes before that
    are settled. Rounds are as many as variable nodes lie on one path, however deep the paths are.
    """
    slashed = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.concat(F.lit("/"), s))
    paths = scratch.cut(paths.withColumn("steps", slashed).withColumn("done", F.lit(0)))
    while True:
        left = _nodes(paths.where("done < size(steps)").select("host", "path", "steps", "done"), F.col("done"))
        children = left.groupBy("host", "level", "a", "b", "step").agg(F.count("*").alias("c"))
        nodes = children.groupBy("host", "level", "a", "b").agg(F.sum("c").alias("n"), F.count("*").alias("k")).where("n > 1").withColumn("p", F.col("k") / F.col("n"))
        bound = F.expr(f"(p + {SURE**2} / (2 * n) - {SURE} * sqrt(p * (1 - p) / n + {SURE**2} / (4 * n * n))) / (1 + {SURE**2} / n)")
        variable = scratch.cut(nodes.where(bound > NEW).select("host", "level", "a", "b"))
        if variable.isEmpty():
            return paths.drop("done")
        first = left.join(variable, ["host", "level", "a", "b"]).groupBy("host", "path").agg(F.min("level").alias("first"))
        before, after = F.slice("steps", F.lit(1), F.col("first")), F.slice("steps", F.col("first") + 2, F.size("steps"))
        one = F.array(F.concat(F.lit("/"), _shape(F.substr(F.get("steps", F.col("first")), F.lit(2)))))
        steps = F.when(F.col("first").isNull(), F.col("steps")).otherwise(F.concat(before, one, after))
        done = F.coalesce(F.col("first") + 1, F.size("steps"))
        after_round = scratch.cut(paths.join(first, ["host", "path"], "left").withColumns({"steps": steps, "done": done}).drop("first"))
        scratch.drop(paths, variable)
        paths = after_round


def _levels(paths: DataFrame) -> list[int]:
    """Levels, deepest first, at which some node has several branches with labels that are mostly bad, or mostly not: where there is something to merge."""
    steps = _nodes(paths.where("labelled > 0").select("host", "steps", "labelled", "n_bad"), F.lit(0))
    node = ["host", "level", "a", "b"]
    branches = steps.groupBy(*node, "step").agg(F.expr("2 * sum(n_bad) >= sum(labelled)").alias("kind"))
    several = branches.groupBy(*node, "kind").agg(F.count("*").alias("k")).where("k > 1")
    return sorted((r[0] for r in several.select("level").distinct().collect()), reverse=True)  # a number for each level


def _merged(scratch: Scratch, paths: DataFrame, at: int) -> DataFrame:
    """``paths`` with the alike branches of every node of level ``at`` as one."""
    far = F.greatest(F.size("steps"), F.lit(1))
    before, after = F.slice("steps", F.lit(1), F.lit(at)), F.slice("steps", F.lit(at + 2), far)
    keys, kinds = ["host", "parent"], ["host", "parent", "kind"]
    paths = paths.withColumn("parent", _joined(before)).withColumn("first", F.get("steps", F.lit(at)))
    named = paths.where("first is not null").withColumn("tail", _joined(after))
    leads = scratch.cut(named.groupBy(*keys, "first", "tail").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "n_bad"))))
    branches = scratch.cut(leads.groupBy(*keys, "first").agg(F.sum("n").alias("size"), F.sum("labelled").alias("labelled"), F.sum("n_bad").alias("bad")).where("labelled > 0").withColumn("kind", F.expr("2 * bad >= labelled")))
    top = branches.groupBy(*kinds).agg(F.count("*").alias("branches"), F.max(F.struct("size", F.col("first").alias("name"), "labelled", "bad")).alias("top"))
    top = scratch.cut(top.where("branches > 1").drop("branches"))
    model = leads.join(top, keys).where("first = top.name").select(*kinds, "tail", F.col("n").alias("m"))
    both = leads.select(*keys, "first", "tail", "n").join(branches.join(top, kinds), [*keys, "first"]).join(model, [*kinds, "tail"], "left")
    both = both.withColumn("of", F.col("top.size")).withColumn("m", F.coalesce("m", F.lit(0)))
    # Two-sample chi-square over the shapes of the branch; shapes that only the largest has add its share of them.
    term = F.expr("pow(sqrt(of / size) * n - sqrt(size / of) * m, 2) / (n + m)")
    like = both.groupBy(*kinds, "first", "size", "labelled", "bad", "top", "of").agg(F.sum(term).alias("chi"), F.count("*").alias("cells"), F.sum("m").alias("met"))
    rate = F.expr("abs(bad / labelled - top.bad / top.labelled)")
    q, r = (f"({x}bad + {WEIGHT * PRIOR}) / ({x}labelled + {WEIGHT})" for x in ("", "top."))
    spread = F.expr(f"if(first = top.name, 0, {SURE} * sqrt({q} * (1 - {q}) / labelled + {r} * (1 - {r}) / top.labelled))")
    like = like.where(F.expr("chi + (of - met) * size / of <= cells + 3 * sqrt(2 * cells)") & (rate <= spread) & (spread <= ALIKE))
    like = like.select(*kinds, "first", F.concat(F.lit("/*"), F.col("top.name")).alias("as"))
    several = like.groupBy(*kinds).agg(F.count("*").alias("k")).where("k > 1").select(*kinds)
    found = scratch.cut(like.join(several, kinds).drop("kind"))
    if found.isEmpty():
        return paths.drop("parent", "first")
    paths = paths.join(found, [*keys, "first"], "left")
    one = F.when(F.col("as").isNotNull(), F.concat(before, F.array("as"), after)).otherwise(F.col("steps"))
    return scratch.cut(paths.withColumn("steps", one).drop("parent", "first", "as"))


def url_filter(pages: DataFrame, *, rules: dict[str, str] | None = None, labels: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    ``labels``: optional rows ``page_id, bad`` (boolean) of URLs that no rule decides. A null URL, or one without
    ``://``, has an empty host and path and is a template of its own. Null ids and repeated rows are judged row by
    row; extra columns are ignored; no rows give no rows.
    """
    rules = RULES if rules is None else rules
    scratch = Scratch(pages.sparkSession, "url-filter")
    u = F.col(url).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    verdicts = F.create_map(*(F.lit(x) for r, v in rules.items() for x in (r, v))) if rules else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("said", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")]))
    rows = rows.withColumn("bad", F.when(F.col("said").isNotNull(), F.col("said") == "block"))
    if labels is not None:
        known = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").alias("told")).dropDuplicates(["page_id"])
        rows = rows.join(known, "page_id", "left").withColumn("bad", F.coalesce("bad", "told")).drop("told")
    rows = scratch.cut(rows)
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("n_bad"))
    paths = _tree(scratch, paths)
    for at in _levels(paths):
        paths = _merged(scratch, paths, at)
    paths = paths.withColumn("template", _joined(F.col("steps")))
    counts = paths.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "n_bad")))
    share = (F.col("n_bad") + WEIGHT * PRIOR) / (F.col("labelled") + WEIGHT)
    sure = F.col("share") - DEVIATIONS * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("labelled") + WEIGHT + 1))
    judged = counts.withColumn("share", share).withColumn("reject", sure >= PURITY)
    judged = judged.select("host", "template", F.round("share", 6).alias("purity"), "reject")
    judged = scratch.cut(paths.select("host", "path", "template").join(judged, ["host", "template"]))
    out = rows.join(judged, ["host", "path"])
    verdict = F.coalesce("said", F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
