"""Readers on small files written here."""

import json

import pytest

from immunoframe.sources import readers


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_native_and_cohort(spark, tmp_path):
    head = "count\tfreq\tcdr3nt\tcdr3aa\tv\td\tj"
    paths = [write(tmp_path / f"s{i}.txt", head, f"3\t0.75\tTGT\tCAS\tTRBV1\t.\tTRBJ{i}", "1.9\t0.25\tTGC\tCAT\tTRBV2\tTRBD1\tTRBJ1") for i in (10, 2)]
    df = readers.read_native(spark, paths)
    rows = {(r.sample_id, r.junction_aa): r for r in df.collect()}
    assert rows["s10", "CAS"].d_call is None and rows["s10", "CAS"].frequency == 0.75 and rows["s2", "CAT"].duplicate_count == 1
    readers.write_cohort(df, str(tmp_path / "cohort"), buckets=4)
    back = readers.read_cohort(spark, str(tmp_path / "cohort"), ["s2"])
    assert sorted(back.collect(), key=str) == sorted(df.where("sample_id = 's2'").collect(), key=str)
    readers.write_native(df, str(tmp_path / "native"))
    assert spark.read.csv(str(tmp_path / "native"), sep="\t", header=True).count() == 4


def test_airr(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "sequence_id\tv_call\tj_call\tjunction\tjunction_aa\tduplicate_count\tproductive", "1\tTRBV1*01\tTRBJ1\tTGTTTT\tCF\t2\tT", "2\tTRBV2\t\tTGT\tC\t\tF")
    rows = readers.read_airr(spark, path).orderBy("v_call").collect()
    assert [(r.sample_id, r.duplicate_count, r.productive, r.j_call) for r in rows] == [("a", 2, True, "TRBJ1"), ("a", 1, False, None)]
    path = write(tmp_path / "b.tsv", "v_call\tj_call\tcdr3_aa\tcdr3_nt\tcount\tfrequency\tv_identity\td_call", "V1\tJ1\tCF\tTGT\t5000.0\t0.5\t0.9\t", "V1\tJ1\tCF\tTGT\t2\t0.1\t0.8\tD2", "V2\tJ1\tCF\tTGT\tx\t0.4\t1.0\t")
    rows = readers.read_airr(spark, path, keep=("v_identity",), recompute=False).orderBy("v_call").collect()
    assert [(r.v_call, r.duplicate_count, round(r.frequency, 6), round(r.v_identity, 6), r.d_call, r.locus) for r in rows] == [("V1", 5002, 0.6, 0.85, "D2", "V1"), ("V2", 1, 0.4, 1.0, None, "V2")]
    assert readers.read_airr(spark, path, collapsed=False).count() == 3
    with pytest.raises(ValueError, match="v_call"):
        readers.read_airr(spark, write(tmp_path / "c.tsv", "junction_aa\tj_call", "CF\tJ1"))


def test_sample_named_by_file(spark, tmp_path):
    head = "sample_id\tv_call\tj_call\tjunction_aa\tjunction\t_metadata"
    path = write(tmp_path / "a.b.tsv.txt.gz.tsv", head, "S1\tV1\tJ1\tCF\tTGT\tx", "\tV2\tJ1\tCF\tTGT\ty")
    df = readers.read_airr(spark, path, collapsed=False)
    assert {(r.sample_id, r.v_call) for r in df.collect()} == {("S1", "V1"), ("a.b", "V2")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "input_file_name" not in plan and "regexp_extract(__metadata" in plan and ".file_name, ^(" in plan  # not the whole path, from each of its letters


def test_clone_exports(spark, tmp_path):
    one = lambda df: (lambda r: (r.v_call, r.d_call, r.j_call, r.junction_aa, r.junction_nt, r.duplicate_count))(df.first())
    path = write(tmp_path / "m.txt", "cloneId\tcloneCount\tallVHitsWithScore\tallDHitsWithScore\tallJHitsWithScore\tallCHitsWithScore\tnSeqCDR3\taaSeqCDR3", "0\t12.0\tTRBV5*00(100),TRBV6*00(9)\t\tTRBJ1*00(1)\t\ttgtgc\tC_~F", "1\t1\t\t\tTRBJ1*00(1)\t\tTGT\tC")
    assert one(readers.read(spark, path)) == ("TRBV5", None, "TRBJ1", "C_~F", "TGTGC", 12) and readers.read(spark, path).count() == 1
    path = write(tmp_path / "g.txt", "Count\tCDR3 nucleotide sequence\tCDR3 amino acid sequence\tV segments\tJ segments\tD segments", "3\tTGTTT\tCtttF\tTRBV1*01\tTRBJ1*01,TRBJ2\t.")
    assert readers.sniff_format(spark, path) == "migec" and one(readers.read(spark, path)) == ("TRBV1", None, "TRBJ1", "C_F", "TGTTT", 3)
    path = write(tmp_path / "t.txt", "Read.count\tCDR3.nucleotide.sequence\tCDR3.amino.acid.sequence\tV.gene\tJ.gene\tD.gene", "3\tTGTTTT\tCF\tTRBV1\tTRBJ1\tTRBD1, TRBD2", "2\tTGTTTT\tCF\tTRBV1\tTRBJ1\t")
    assert one(readers.read(spark, path)) == ("TRBV1", "TRBD1", "TRBJ1", "CF", "TGTTTT", 5)
    path = write(tmp_path / "r.txt", "Number of reads\tV gene\tJ gene\tJunction nucleotide sequence", "4\tTRBV1*01\tTRBJ1*01\tTGTAAATTTC")
    assert one(readers.read(spark, path)) == ("TRBV1", None, "TRBJ1", "C_F", "TGTAAATTTC", 4)
    path = write(tmp_path / "h.txt", "Sequence\tV-GENE and allele\tJ-GENE and allele\tD-GENE and allele\tJUNCTION", "x\tHomsap IGHV2-26*01 F\tHomsap IGHJ4*02 F\t\ttgttgg", "y\tHomsap IGHV2-26*02 F\tHomsap IGHJ4*02 F\t\ttgttgg", "z\tHomsap IGHV1*02 F\tHomsap IGHJ4*02 F\t\ttgnnnn")
    assert one(readers.read(spark, path)) == ("IGHV2-26", None, "IGHJ4", "CW", "TGTTGG", 2)
    path = write(tmp_path / "u.tsv", "#count\tfrequency\tCDR3nt\tCDR3aa\tV\tD\tJ\tC\tcid\tcid_full_length", "6\t0.5\tTGTTGG\tC?W\tIGHV1*01\t*\tIGHJ1*01\tIGHM\ta\t1", "6\t0.5\tpartial\tC\tIGHV1\t*\tIGHJ1\tIGHM\ta\t1")
    assert one(readers.read(spark, path)) == ("IGHV1", None, "IGHJ1", "C_W", "TGTTGG", 6)
    path = write(tmp_path / "i.tsv", "rearrangement\tamino_acid\tframe_type\tv_index\tcdr3_length\tv_gene\tv_family\td_gene\tj_gene\ttemplates\treads", "AATGTTTTCC\tCF\tIn\t2\t6\tunresolved\tTCRBV05\tunresolved\tTCRBJ02-03\tnull\t7")
    assert one(readers.read(spark, path)) == ("TRBV5", None, "TRBJ2-3", "CF", "TGTTTT", 7)
    names = spark.createDataFrame([("TCRBV05", "TRBV5-1")], "token string, gene string")
    assert readers.read_immunoseq(spark, path, names=names).first().v_call == "TRBV5-1"
    clone = {"sequence": "AATGTTTTCC", "reads": [5, 8], "seg": {"5": {"name": "V*01"}, "3": "J", "junction": {"start": 3, "stop": 8, "aa": "CF"}}}
    path = write(tmp_path / "v.vidjil", json.dumps({"clones": [clone, {"sequence": "A", "reads": [1, 1]}]}))
    assert one(readers.read(spark, path)) == ("V", None, "J", "CF", "TGTTTT", 5) and readers.read_vidjil(spark, path, sample_id=1).first().duplicate_count == 8
    with pytest.raises(Exception, match="out of range"):
        readers.read_vidjil(spark, path, sample_id=2).collect()
    with pytest.raises(ValueError, match="unknown kind"):
        readers.read(spark, write(tmp_path / "x.txt", "a\tb", "1\t2"))


def test_parquet_and_samples(spark, tmp_path):
    rows = [("IGHV3-23*01,IGHV3-23D*01", "IGHJ1", "CW", "TGTTGG", 3, 0.75)]
    spark.createDataFrame(rows, "v_call string, j_gene string, junction_aa string, cdr3_nt string, count long, freq double").write.parquet(str(tmp_path / "p.parquet"))
    r = readers.read(spark, str(tmp_path / "p.parquet"), recompute=False).first()
    assert (r.v_call, r.j_call, r.duplicate_count, r.frequency, r.locus) == ("IGHV3-23*01,IGHV3-23D*01", "IGHJ1", 3, 0.75, "IGH")
    head = "count\tfreq\tcdr3nt\tcdr3aa\tv\td\tj"
    for s, v in (("a", "TRBV1, TRBV2"), ("b", "TRBV3")):
        write(tmp_path / f"{s}.tsv", head, f"3\t0.75\tTGT\tCAS\t{v}\t.\tTRBJ1")
    meta = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_name string, group string")
    got = readers.read_samples(spark, meta, str(tmp_path), sample="sample_name", template="{sample}.tsv")
    assert sorted((r.sample_id, r.v_call, r.file_name, r.group) for r in got.collect()) == [("a", "TRBV1", "a.tsv", "x"), ("b", "TRBV3", "b.tsv", "y")]
    assert sorted(r[0] for r in readers.map_samples(got, lambda x: x[["sample_id"]], "sample_id string").collect()) == ["a", "b"]


def test_cells_round_trip(spark, tmp_path):
    path = write(tmp_path / "cells.tsv", "cell_id\tsequence_id\tv_call\tj_call\tjunction\tjunction_aa\tconsensus_count\tumi_count\tproductive", "c1\tc1_1\tTRAV1\tTRAJ1\tTGT\tC\t9\t2\tT", "c1\t\tTRBV1\tTRBJ1\tTGC\tC\t5\t1\tF")
    with pytest.raises(ValueError, match="cell_id"):
        readers.read(spark, path)
    cells = readers.read_airr_cell(spark, path)
    assert sorted((r.cell_id, r.locus, r.duplicate_count, r.umi_count, r.productive) for r in cells.collect()) == [("c1", "TRA", 9, 2, True), ("c1", "TRB", 5, 1, False)]
    readers.write_cells(cells, str(tmp_path / "airr"))
    back = readers.read_airr_cell(spark, str(tmp_path / "airr"))
    assert sorted((r.cell_id, r.v_call, r.junction_nt, r.duplicate_count) for r in back.collect()) == [("c1", "TRAV1", "TGT", 9), ("c1", "TRBV1", "TGC", 5)]
    readers.write_cells(cells, str(tmp_path / "contigs"), fmt="10x")
    assert readers.read_contigs(spark, str(tmp_path / "contigs")).count() == 2
    fasta = readers.read_fasta(spark, write(tmp_path / "s.fa", ">one two", "ACG", "TT", ">b", "GG")).collect()
    assert sorted((r.header, r.sequence) for r in fasta) == [("b", "GG"), ("one two", "ACGTT")]


def test_contigs_and_metadata(spark, tmp_path):
    head = "barcode,is_cell,contig_id,high_confidence,length,chain,v_gene,d_gene,j_gene,c_gene,productive,cdr3,cdr3_nt,reads,umis,raw_clonotype_id"
    path = write(tmp_path / "c.csv", head, "b1,True,b1_1,True,500,TRA,TRAV1,,TRAJ1,TRAC,True,CAF,TGT,9,3,c1", "b2,False,b2_1,True,500,TRA,TRAV1,,TRAJ1,TRAC,True,CAF,TGT,9,3,c1")
    rows = readers.read_contigs(spark, path).collect()
    assert [(r.cell_id, r.umi_count, r.duplicate_count, r.productive) for r in rows] == [("b1", 3, 9, True)]
    rows = readers.read_metadata(spark, write(tmp_path / "meta.txt", "#sample_name\tage", "s1\tnan", "s2\t4")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.age) for r in rows] == [("s1", None), ("s2", "4")]


def test_files_of_other_headers(spark, tmp_path):
    """Every file is read by its own header: other order, other columns, compressed, empty; late text in a kept column stays."""
    import gzip

    head = ["count", "freq", "cdr3nt", "cdr3aa", "v", "d", "j"]
    row = {"count": "7", "freq": "0.5", "cdr3nt": "TGTTTT", "cdr3aa": "CF", "v": "TRBV1*01", "d": ".", "j": "TRBJ1-1*01"}
    orders = {"a": head, "b": head[::-1], "c": ["v", "j", "cdr3aa", "cdr3nt", "count"]}
    for name, order in orders.items():
        text = "\t".join(order) + "\n" + "\t".join(row[c] for c in order) + "\n"
        (tmp_path / f"{name}.tsv.gz").write_bytes(gzip.compress(text.encode())) if name == "b" else (tmp_path / f"{name}.tsv").write_text(text)
    (tmp_path / "empty.tsv").write_text("")
    got = {r.sample_id: (r.v_call, r.j_call, r.junction_nt, r.junction_aa, r.duplicate_count) for r in readers.read_native(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c"} and set(got.values()) == {("TRBV1*01", "TRBJ1-1*01", "TGTTTT", "CF", 7)}
    notes = ["" if i < 150 else "late" if i < 200 else "1" for i in range(300)]
    lines = ["v_call\tj_call\tjunction\tjunction_aa\tduplicate_count\tnote"] + [f"TRBV1\tTRBJ1\tTGT{i}\tC{i}\t1\t{n}" for i, n in enumerate(notes)]
    (tmp_path / "airr").mkdir()
    (tmp_path / "airr" / "x.tsv").write_text("\n".join(lines))
    assert readers.read_airr(spark, str(tmp_path / "airr"), collapsed=False, keep=("note",)).where("note = 'late'").count() == 50
