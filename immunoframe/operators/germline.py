"""Germline libraries: tables of alleles, their conserved anchors, their audit, and models that start from them.

A germline table has a row for each allele: ``allele, segment`` (V, D or J) and ``sequence``, which of a V begins with the codon of the conserved Cys and of
a J ends with that of the conserved Phe or Trp; of a D it is whole. ``full``: the whole V or J sequence, ``anchor``: where the conserved codon begins in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clonotype import translate
from ..sources.readers import read_fasta
from .recombination import Model, Segment, palindrome

#: Residues beside an anchor that are compared: before that of a V, behind that of a J.
CONTEXT = 8
#: Palindromic bases at an end that may be trimmed.
PALINDROME = 4


def find_anchors(full: DataFrame) -> DataFrame:
    """``allele, segment, anchor``: where the codon of the conserved residue begins in whole V and J sequences (``allele, segment, full``), from 0; null where no frame has one.

    Candidates are the Cys codons of a V (Phe and Trp codons of a J) in all three frames. Alleles vote: what stands at a distance from a candidate counts
    by how many alleles of the segment have a candidate with the same residue there. At first the last candidate of each frame of a V (the first of a J)
    has a vote, then the winners of this. A candidate
    with a stop codon between it and the far end of its segment counts half. Ties go to the last candidate of a V, the first of a J. Letters other
    than ACGT give residues that match nothing. Repeated rows of an allele are taken once; other segments, and null sequences, have no row.
    """
    rows = full.where("segment in ('V', 'J') and full is not null").groupBy("allele", "segment").agg(F.upper(F.min("full")).alias("full"))
    frames = rows.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("frame"))
    frames = frames.withColumn("aa", F.split(translate(F.expr("substr(full, frame + 1)")), ""))
    placed = frames.select("allele", "segment", "frame", "aa", F.posexplode("aa").alias("pos", "residue"))
    placed = placed.where(((F.col("segment") == "V") & (F.col("residue") == "C")) | ((F.col("segment") == "J") & F.col("residue").isin("F", "W")))
    of_v = F.col("segment") == "V"
    beside = F.when(of_v, F.expr("slice(aa, 1, pos)")).otherwise(F.expr("slice(aa, pos + 2, size(aa))"))
    at = F.when(of_v, F.col("pos") - F.col("offset")).otherwise(F.col("pos") + F.col("offset"))
    found = placed.select("allele", "segment", "pos", "aa", (F.col("frame") + 3 * F.col("pos")).alias("anchor"), F.array_contains(beside, "*").alias("stop"))
    context = found.select("*", F.explode(F.array(*map(F.lit, range(1, CONTEXT + 1)))).alias("offset")).select("allele", "segment", "anchor", "stop", "offset", F.get("aa", at).alias("residue"))
    best = found.groupBy("allele", "segment", F.col("anchor") % 3).agg(F.when(of_v, F.max("anchor")).otherwise(F.min("anchor")).alias("anchor")).select("allele", "segment", "anchor")
    for _ in range(2):
        votes = context.join(best, ["allele", "segment", "anchor"]).where("residue not in ('X', '*')").groupBy("segment", "offset", "residue").agg(F.countDistinct("allele").alias("votes"))
        # a whole number, so that ties are ties in any order
        scored = context.join(votes, ["segment", "offset", "residue"], "left").groupBy("allele", "segment", "anchor", "stop").agg(F.sum(F.coalesce("votes", F.lit(0))).alias("score"))
        score = F.col("score") * F.when(F.col("stop"), 1).otherwise(2)
        order = F.struct(score, F.when(F.col("segment") == "V", F.col("anchor")).otherwise(-F.col("anchor")))
        best = scored.groupBy("allele", "segment").agg(F.max_by("anchor", order).alias("anchor"))
    return rows.select("allele", "segment").join(best, ["allele", "segment"], "left")


def read_germline(spark: SparkSession, v: str, j: str, d: str | None = None, *, anchors: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """A germline table of sequence files, one for each segment: ``allele, gene, segment, sequence, full, anchor, functional``.

    The allele is the second field of a header with ``|``, else the header. ``anchors`` (``gene, anchor_index, function``) makes the V and J files those of whole
    sequences, which are cut at the anchors; alleles without one stay whole, as the audit then tells. ``whole``: the same with anchors that
    :func:`find_anchors` finds. An allele is functional if its function is F or not given.
    """
    parts = [read_fasta(spark, path).withColumn("segment", F.lit(s)) for s, path in (("V", v), ("J", j), ("D", d)) if path]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    fields = F.split("header", r"\|")
    rows = rows.select(F.trim(F.coalesce(F.get(fields, F.lit(1)), fields[0])).alias("allele"), "segment", F.upper(F.trim("sequence")).alias("sequence"))
    if anchors is not None:
        known = anchors.select(F.col("gene").alias("allele"), F.col("anchor_index").cast("int").alias("anchor"), F.col("function").alias("_function")).dropDuplicates(["allele"])
        rows = rows.join(known, "allele", "left")
    elif whole:
        rows = rows.join(find_anchors(rows.withColumnRenamed("sequence", "full")), ["allele", "segment"], "left").withColumn("_function", F.lit("F"))
    else:
        rows = rows.withColumns({"anchor": F.lit(None).cast("int"), "_function": F.lit("F")})
    cut = (F.col("segment") != "D") & (F.col("anchor") >= 0)
    own = F.when(F.col("segment") == "V", F.expr("substr(sequence, anchor + 1)")).otherwise(F.expr("substr(sequence, 1, anchor + 3)"))
    functional = (F.col("segment") == "D") | (F.coalesce("_function", F.lit("F")) == "F")
    return rows.select(
        "allele", F.regexp_replace("allele", r"\*.*$", "").alias("gene"), "segment", F.when(cut, own).otherwise(F.col("sequence")).alias("sequence"),
        F.when(cut, F.col("sequence")).alias("full"), "anchor", functional.alias("functional"),
    )


def _usable() -> Column:
    return F.upper("sequence").rlike("^[ACGT]+$")


def validate_germline(germline: DataFrame) -> DataFrame:
    """What is wrong with a germline table: ``severity`` (error or warn), ``check, segment, allele, n`` (how often). Empty if it is clean.

    Errors: a segment other than V, D and J, no V or no J, an allele that stands more than once, without name or without sequence. Warnings: a name without
    ``*``, letters other than ACGT (such alleles are left out of models), and a V that doesn't begin with Cys or a J that doesn't end with Phe or Trp,
    which is an anchor at the wrong place.
    """
    rows = germline.select(F.coalesce("allele", F.lit("")).alias("allele"), F.coalesce("segment", F.lit("")).alias("segment"), F.upper(F.coalesce("sequence", F.lit(""))).alias("sequence"))
    named, filled = F.col("allele") != "", F.col("sequence") != ""
    plain = named & filled & _usable()
    v_ok = translate(F.substring("sequence", 1, 3)) == "C"
    j_ok = translate(F.expr("right(sequence, 3)")).isin("F", "W") | (F.length("sequence") < 3)
    checks = [
        ("error", "segment", ~F.col("segment").isin("V", "D", "J")), ("error", "empty_allele", ~named), ("warn", "gene_level_name", named & ~F.contains("allele", F.lit("*"))),
        ("error", "empty_sequence", named & ~filled), ("warn", "ambiguous", named & filled & ~_usable()),
        ("warn", "anchor_frame", plain & (((F.col("segment") == "V") & ~v_ok) | ((F.col("segment") == "J") & ~j_ok))),
    ]
    issues = F.filter(F.array(*(F.when(on, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("check"))) for s, c, on in checks)), lambda x: x.isNotNull())
    single = rows.select(F.explode(issues).alias("e"), "segment", "allele").groupBy("e", "segment", "allele").agg(F.count("*").alias("n")).select("e.severity", "e.check", "segment", "allele", "n")
    double = rows.where(named).groupBy("allele").agg(F.count("*").alias("n"), F.min("segment").alias("segment")).where("n > 1")
    double = double.select(F.lit("error").alias("severity"), F.lit("duplicate_allele").alias("check"), "segment", "allele", "n")
    counts = rows.agg(*(F.count_if(F.col("segment") == s).alias(s) for s in "VJ"))
    none = counts.select(F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), F.col(s).alias("n")) for s in "VJ"))).alias("e")).where("e.n = 0")
    none = none.select(F.lit("error").alias("severity"), F.lit("segment_missing").alias("check"), "e.segment", F.lit("").alias("allele"), "e.n")
    return single.unionByName(double).unionByName(none)


def forbidden_dj_pairs(germline: DataFrame) -> DataFrame:
    """``d_allele, j_allele`` that can't be joined, as the J lies before the D: in TRB the clusters of D and J take turns, in other loci every D lies before every J."""
    part = lambda s: germline.where((F.col("segment") == s) & F.upper("allele").startswith("TRB")).select(F.col("allele").alias(f"{s.lower()}_allele"), F.try_to_number(F.regexp_extract("allele", rf"^[^*]*?{s}(\d+)", 1), F.lit("999999")).alias(f"_{s}")).distinct()
    d = part("D").dropna()
    # a J of cluster k is joined with the D of each higher cluster: numbers first, so that only wanted pairs are made
    behind = part("J").dropna().join(d.select("_D").distinct(), F.col("_J") < F.col("_D"))
    return behind.join(d, "_D").select("d_allele", "j_allele")


def _decaying(n: int, scale: float, zero: int = 0) -> np.ndarray:
    w = np.exp(-np.abs(np.arange(n) - zero) / scale)
    return w / w.sum()


def from_germline(germline: DataFrame, *, insert_max: int = 40, palindrome_max: int = PALINDROME, strict: bool = True) -> Model:
    """A model to be fitted: alike usage of functional alleles (of all, if none is), short trims and inserts most likely, all up to the whole length possible.

    With a D the joints that can't be have probability 0. Alleles with other letters than ACGT are left out. ``strict`` raises on errors of the audit. The
    library is small and is read on the driver, as a model is.
    """
    errors = validate_germline(germline).where("severity = 'error'").select("check", "allele").distinct()
    found = [f"{r['check']} {r['allele']}".strip() for r in errors.limit(5).collect()] if strict else []
    if found:
        raise ValueError("the germline has errors: " + "; ".join(found))
    functional = F.col("functional") if "functional" in germline.columns else F.lit(True)
    newest = Window.partitionBy("allele").orderBy("segment", "sequence")
    rows = germline.where(_usable() & F.col("segment").isin("V", "D", "J") & (F.coalesce("allele", F.lit("")) != ""))
    rows = rows.select("allele", "segment", F.upper("sequence").alias("sequence"), F.coalesce(functional, F.lit(True)).alias("functional"), F.row_number().over(newest).alias("_n")).where("_n = 1").orderBy("allele").collect()
    of = {s: [r for r in rows if r["segment"] == s] for s in "VDJ"}
    if not of["V"] or not of["J"]:
        raise ValueError(f"no usable {'V' if not of['V'] else 'J'} alleles")
    usage = {s: np.array([float(r["functional"]) for r in x]) if any(r["functional"] for r in x) else np.ones(len(x)) for s, x in of.items()}
    share = {s: x / x.sum() for s, x in usage.items() if len(x)}
    pal = palindrome_max
    ends = {"V": (0, pal), "J": (pal, 0), "D": (pal, pal)}
    cut = {s: [palindrome(r["sequence"], min(ends[s][0], len(r["sequence"])), min(ends[s][1], len(r["sequence"]))) for r in x] for s, x in of.items()}
    v, j = ([Segment(r["allele"], c, _decaying(len(c) + 1, 4.0, min(pal, len(r["sequence"])))) for r, c in zip(of[s], cut[s], strict=True)] for s in "VJ")
    insert, step = _decaying(insert_max + 1, 4.0), np.full((4, 4), 0.25)
    if not of["D"]:
        return Model(v, j, share["V"], np.tile(share["J"], (len(v), 1)), [insert], [step])
    d = []
    for r, c in zip(of["D"], cut["D"], strict=True):
        one = _decaying(len(c) + 1, 4.0, min(pal, len(r["sequence"])))
        both = np.outer(one, one) * (np.add.outer(np.arange(len(c) + 1), np.arange(len(c) + 1)) <= len(c))
        d.append(Segment(r["allele"], c, both / both.sum()))
    never = {(r["d_allele"], r["j_allele"]) for r in forbidden_dj_pairs(germline).collect()}  # a row for pairs of a small library
    p_d = np.array([[0.0 if (x.name, y.name) in never else s for x, s in zip(d, share["D"], strict=True)] for y in j])
    p_d = np.array([row / row.sum() if row.sum() else np.zeros(len(d)) for row in p_d])
    p_j = np.where(p_d.sum(axis=1) > 0, share["J"], 0.0)
    return Model(v, j, share["V"], p_j / p_j.sum(), [insert, insert], [step, step], d, p_d)
