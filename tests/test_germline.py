"""Germline tables: anchors, audit, and models that start from them."""

import random

import numpy as np
import pytest

from immunoframe.functions.clonotype import CODONS
from immunoframe.operators.germline import find_anchors, forbidden_dj_pairs, from_germline, read_germline, validate_germline
from immunoframe.operators.recombination import palindrome, pgen_nt

SCHEMA = "allele string, segment string, sequence string"
TOY = [("TRBV1*01", "V", "TGTGCCAGC"), ("TRBV1*02", "V", "TGTGCCAGT"), ("TRBJ1-1*01", "J", "AACTATACCTTT"), ("TRBJ2-1*01", "J", "AACGAGCAGTTT"), ("TRBD1*01", "D", "GGGACAG"), ("TRBD2*01", "D", "GGGACTAG")]


def nt(rng, residues):
    """A sequence of these residues."""
    return "".join(rng.choice([c for c, a in CODONS.items() if a == x]) for x in residues)


def test_anchors(spark):
    """Whole segments in unlike frames, with other Cys and Phe codons in and out of frame."""
    rng = random.Random(8)
    some = lambda k, of="ADEGHIKLMNPQRSTV": "".join(rng.choice(of) for _ in range(k))
    rows, want = [], {}
    for i in range(24):
        lead, ahead = rng.randrange(3), some(20) + "C" + some(40) + rng.choice(["EDSAVYY", "EDTALYF", "GDSAVYL"])
        rows.append((f"V{i}*01", "V", "A" * lead + nt(rng, ahead + "CA" + some(3))))
        want[f"V{i}*01"] = lead + 3 * len(ahead)
        lead, head = rng.randrange(3), some(rng.randrange(2, 6)) + ("F" if i % 4 == 0 else "")
        rows.append((f"J{i}*01", "J", "C" * lead + nt(rng, head + rng.choice("FW") + "G" + rng.choice("QAP") + "GT" + rng.choice("RK") + "LTV" + rng.choice("LI"))))
        want[f"J{i}*01"] = lead + 3 * len(head)
    rows += [("D1*01", "D", "TGTTGT"), ("V98*01", "V", None), ("V99*01", "V", "AAAAAAAAAA"), rows[0]]
    got = {r.allele: r.anchor for r in find_anchors(spark.createDataFrame(rows, "allele string, segment string, full string")).collect()}
    assert got == {**want, "V99*01": None}
    assert find_anchors(spark.createDataFrame([], "allele string, segment string, full string")).count() == 0


def test_read_germline(spark, tmp_path):
    for name, text in {"v": ">x|TRBV1*01|Homo\naaatgt\nagc\n>TRBV2*01\nTGTGCC\n", "j": ">TRBJ1-1*01\nAACTTTGGG\n", "d": ">a|TRBD1*01\nGGGACA\n"}.items():
        (tmp_path / name).write_text(text)
    anchors = spark.createDataFrame([("TRBV1*01", 3, "F"), ("TRBJ1-1*01", 3, "P")], "gene string, anchor_index int, function string")
    paths = [str(tmp_path / x) for x in "vjd"]
    cut = {r.allele: (r.gene, r.segment, r.sequence, r.full, r.functional) for r in read_germline(spark, *paths, anchors=anchors).collect()}
    assert cut == {
        "TRBV1*01": ("TRBV1", "V", "TGTAGC", "AAATGTAGC", True), "TRBV2*01": ("TRBV2", "V", "TGTGCC", None, True),
        "TRBJ1-1*01": ("TRBJ1-1", "J", "AACTTT", "AACTTTGGG", False), "TRBD1*01": ("TRBD1", "D", "GGGACA", None, True),
    }
    found = {r.allele: r.sequence for r in read_germline(spark, *paths, whole=True).collect()}
    assert found["TRBJ1-1*01"] == "AACTTT" and found["TRBV1*01"] == "TGTAGC" and found["TRBD1*01"] == "GGGACA"


def test_audit(spark):
    assert validate_germline(spark.createDataFrame(TOY, SCHEMA)).count() == 0
    bad = [("TRBV1", "V", "TGTNCC"), ("TRBV2*01", "V", "GGGTGT"), ("TRBV2*01", "V", "tgtgcc"), (None, "J", "TTT"), ("X*01", "Q", ""), ("TRBD1*01", "D", None)]
    got = {(r.severity, r.check, r.segment, r.allele, r.n) for r in validate_germline(spark.createDataFrame(bad, SCHEMA)).collect()}
    assert got == {
        ("warn", "gene_level_name", "V", "TRBV1", 1), ("warn", "ambiguous", "V", "TRBV1", 1), ("warn", "anchor_frame", "V", "TRBV2*01", 1), ("error", "duplicate_allele", "V", "TRBV2*01", 2),
        ("error", "empty_allele", "J", "", 1), ("error", "segment", "Q", "X*01", 1), ("error", "empty_sequence", "Q", "X*01", 1), ("error", "empty_sequence", "D", "TRBD1*01", 1),
    }
    none = {(r.check, r.segment, r.n) for r in validate_germline(spark.createDataFrame([], SCHEMA)).collect()}
    assert none == {("segment_missing", "V", 0), ("segment_missing", "J", 0)}


def test_models_of_germlines(spark):
    germline = spark.createDataFrame(TOY, SCHEMA)
    assert [tuple(r) for r in forbidden_dj_pairs(germline).collect()] == [("TRBD2*01", "TRBJ1-1*01")]
    assert forbidden_dj_pairs(spark.createDataFrame([("IGHD2*01", "D", "A"), ("IGHJ1*01", "J", "A")], SCHEMA)).count() == 0
    model = from_germline(germline)
    assert [x.name for x in model.d] == ["TRBD1*01", "TRBD2*01"] and np.allclose(model.p_d, [[1, 0], [0.5, 0.5]]) and np.allclose(model.p_v, 0.5)
    assert model.v[0].cut == palindrome("TGTGCCAGC", 0, 4) and all(np.isclose(x.trim.sum(), 1) for x in [*model.v, *model.j, *model.d])
    plain = from_germline(germline.where("segment <> 'D'"), insert_max=3)
    junctions = spark.createDataFrame([("TGTGCCAGCAACTATACCTTT",), ("TGTGCC",)], "junction_nt string")
    p = {r["junction_nt"]: r["pgen"] for r in pgen_nt(junctions, plain).collect()}
    assert 0 < p["TGTGCCAGCAACTATACCTTT"] < 1
    with pytest.raises(ValueError, match="duplicate_allele"):
        from_germline(spark.createDataFrame([*TOY, TOY[0]], SCHEMA))
    assert len(from_germline(spark.createDataFrame([*TOY, TOY[0]], SCHEMA), strict=False).v) == 2
    with pytest.raises(ValueError, match="no usable J"):
        from_germline(spark.createDataFrame(TOY[:2], SCHEMA), strict=False)
