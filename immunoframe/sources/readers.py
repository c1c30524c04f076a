"""Readers of the common exchange formats into the fixed clonotype schema, and cohorts as partitioned Parquet.

Every reader takes one path, a list or a pattern and reads all files as one DataFrame: a cohort is one scan.
Without a ``sample_id`` of its own a row belongs to the sample named by its file.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clonotype import SAMPLE, add_locus, count_of, extract_vdj, first_call, imgt_gene, normalize, recompute_frequency, to_int, translate_junction, truthy, unified_cdr3aa

Paths = str | list[str]


#: Names that a column may have, the first one that there is counting; after the exchange standard.
ALIASES = {
    "v_call": ("v_call", "v_gene"), "d_call": ("d_call", "d_gene"), "j_call": ("j_call", "j_gene"), "c_call": ("c_call", "c_gene"), "junction_aa": ("junction_aa", "cdr3_aa"),
    "junction_nt": ("junction_nt", "junction", "cdr3_nt", "cdr3"), "duplicate_count": ("duplicate_count", "count", "reads"), "frequency": ("frequency", "freq", "frequency_percent", "frac"),
}
#: Names of the columns in each tool's export, in lower case.
EXPORTS = {
    "mixcr": {
        "duplicate_count": ("clone count", "clonecount", "readcount", "uniquetagcountmolecule"), "v_call": ("all v hits", "allvhitswithscore"), "d_call": ("all d hits", "alldhitswithscore"), "j_call": ("all j hits", "alljhitswithscore"),
        "c_call": ("all c hits", "allchitswithscore"), "junction_nt": ("n. seq. cdr3", "nseqcdr3", "nseqimputedcdr3"), "junction_aa": ("aa. seq. cdr3", "aaseqcdr3", "aaseqimputedcdr3"),
    },
    "migec": {"duplicate_count": ("count",), "v_call": ("v segments",), "d_call": ("d segments",), "j_call": ("j segments",), "junction_nt": ("cdr3 nucleotide sequence",), "junction_aa": ("cdr3 amino acid sequence",)},
    "mitcr": {"duplicate_count": ("read.count",), "v_call": ("v.gene",), "d_call": ("d.gene",), "j_call": ("j.gene",), "junction_nt": ("cdr3.nucleotide.sequence",), "junction_aa": ("cdr3.amino.acid.sequence",)},
    "rtcr": {"duplicate_count": ("number of reads",), "v_call": ("v gene",), "j_call": ("j gene",), "junction_nt": ("junction nucleotide sequence",)},
    "imgt": {"v_call": ("v-gene and allele",), "d_call": ("d-gene and allele",), "j_call": ("j-gene and allele",), "junction_nt": ("junction",)},
    "trust4": {"duplicate_count": ("count",), "v_call": ("v",), "d_call": ("d",), "j_call": ("j",), "c_call": ("c",), "junction_nt": ("cdr3nt",), "junction_aa": ("cdr3aa",)},
}


#: Files whose first lines are read at a time.
AT_ONCE = 32


def _files(spark: SparkSession, paths: Paths) -> list[str]:
    return sorted(spark.read.text(paths).inputFiles())


def first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a text file, compressed or not, in any store that Spark reads; nothing else of it is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        text = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()


def by_header(spark: SparkSession, paths: Paths) -> list[list[str]]:
    """The files, those of one header together; empty files are left out. The driver holds the names of files and different headers."""
    files = _files(spark, paths)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        lines = pool.map(lambda f: first_line(spark, f), files)
    groups: dict[str, list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line is not None:
            groups.setdefault(line.lstrip("\ufeff").rstrip("\r"), []).append(file)
    return list(groups.values())


def _table(spark: SparkSession, paths: Paths, sep: str = "\t", quote: str = "", limit: int | None = None, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """All columns as text, the header in lower case without a leading ``#``; an empty cell or a dot is null.

    Every file is read by its own header: files of one header are one scan, columns that a file lacks are null. ``names``: adds what
    each file has under the first of several names (see :func:`_named`).
    """
    read = lambda files: spark.read.csv(files, sep=sep, header=True, inferSchema=False, enforceSchema=False, nullValue="", quote=quote, escape=quote or "\\")
    parts = []
    for files in by_header(spark, paths) or [paths]:
        df = read(files)
        df = df.select(*(F.col(f"`{c}`").alias(c.lstrip("#").strip().lower()) for c in df.columns), _sample_of_file(df).alias("_file"))
        df = df.select(*(F.when(F.col(f"`{c}`") != ".", F.col(f"`{c}`")).alias(c) for c in df.columns))
        parts.append(df.withColumns({f"_as {c}": _column(df, *given) for c, given in (names or {}).items()}))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.limit(limit) if limit is not None else df


def _sample_of_file(df: DataFrame) -> Column:
    """The name without folder and extensions of the file of each row of ``df``, the scan itself; the pattern is tried from one place only."""
    return F.regexp_extract(df.metadataColumn("_metadata")["file_name"], r"^([^/]+?)(?:\.(?:txt|tsv|csv|json|vidjil|parquet|pq|gz|bz2|zst))*$", 1)


def _column(df: DataFrame, *names: str) -> Column:
    """The first of the columns that there is."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))


def _named(df: DataFrame, c: str, names: tuple[str, ...]) -> Column:
    """The first of several columns that there is, in each file if files differ."""
    return F.col(f"`_as {c}`") if f"_as {c}" in df.columns else _column(df, *names)


def _needed(df: DataFrame, names: dict[str, tuple[str, ...]], needed: tuple[str, ...], kind: str) -> None:
    missing = [c for c in needed if not any(n in df.columns for n in names[c])]
    if missing:
        raise ValueError(f"not a table of kind {kind}: no column for {', '.join(missing)} among {', '.join(df.columns[:12])}")


def _keep_frequency(df: DataFrame, recompute: bool) -> bool:
    """Whether the table's own frequencies stand: asked for, and there are some."""
    return not recompute and "frequency" in df.columns and not df.where("frequency is not null").isEmpty()


def collapse(df: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each sample, V, J and junction: counts (and frequencies) summed, D and C the first that there is, kept numbers averaged."""
    key = [c for c in (SAMPLE, "v_call", "j_call", "junction_nt", "junction_aa") if c in df.columns]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).cast("string")))).alias(c)
    numbers = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")}
    rest = [F.avg(c).alias(c) if c in numbers else first(c) for c in keep if c in df.columns]
    rest += [F.sum("frequency").alias("frequency")] if "frequency" in df.columns else []
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    return numbered.groupBy(*key).agg(F.sum("duplicate_count").alias("duplicate_count"), *(first(c) for c in ("d_call", "c_call") if c in df.columns), *rest)


def finalize(df: DataFrame) -> DataFrame:
    """Clonotypes with junctions, both calls and a positive count, each once, with frequencies and locus."""
    ok = " and ".join(f"coalesce({c}, '') != ''" for c in ("junction_nt", "junction_aa")) + " and v_call is not null and j_call is not null and duplicate_count > 0"
    return add_locus(normalize(collapse(df.where(ok)), recompute=True))


def read_native(spark: SparkSession, paths: Paths, *, keep: tuple[str, ...] = (), recompute: bool = True, limit: int | None = None) -> DataFrame:
    """Tables of ``count, freq, cdr3nt, cdr3aa, v, d, j``: the first call of a list; ``recompute=False`` keeps the file's frequencies."""
    df = _table(spark, paths, limit=limit)
    out = df.select(
        F.col("_file").alias(SAMPLE), *(first_call(_column(df, c)).alias(f"{c}_call") for c in "vdj"), _column(df, "cdr3aa").alias("junction_aa"),
        _column(df, "cdr3nt").alias("junction_nt"), _column(df, "count").alias("duplicate_count"), _column(df, "freq").alias("frequency"), *(c for c in keep if c in df.columns),
    )
    return add_locus(normalize(out, keep=keep, recompute=not _keep_frequency(out, recompute)))


def _aliased(df: DataFrame, keep: tuple[str, ...], numbers: bool) -> DataFrame:
    """The standard columns by their aliases; kept columns of text as numbers where every value of all rows reads as such."""
    named = [_named(df, c, names).alias(c) for c, names in ALIASES.items() if any(n in df.columns for n in names)]
    count = [] if any(n in df.columns for n in ALIASES["duplicate_count"]) else [F.lit("1").alias("duplicate_count")]
    extra = [c for c in keep if c in df.columns]
    if numbers and extra:
        bad = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in extra)).first()
        kept = [F.col(c).try_cast("double").alias(c) if not bad[c] else F.col(c) for c in extra]
    else:
        kept = [F.col(c) for c in extra]
    sample = F.coalesce(_column(df, "sample_id", "repertoire_id"), F.col("_file"))
    return df.select(sample.alias(SAMPLE), *named, *count, *kept, *([truthy(F.col("productive")).alias("productive")] if "productive" in df.columns and "productive" not in keep else []))


def read_airr(spark: SparkSession, paths: Paths, *, collapsed: bool = True, keep: tuple[str, ...] = (), recompute: bool = True, limit: int | None = None) -> DataFrame:
    """Rearrangement tables; a row without a readable count is one read. ``collapsed``: one row for each clonotype."""
    df = _table(spark, paths, limit=limit, names=ALIASES)
    _needed(df, ALIASES, ("junction_aa", "v_call", "j_call"), "airr")
    out = _aliased(df, keep, numbers=True)
    out = out.withColumn("duplicate_count", F.coalesce(count_of(F.col("duplicate_count")), F.lit(1)))
    out = out.withColumn("frequency", F.col("frequency").try_cast("double")) if "frequency" in out.columns else out
    own = _keep_frequency(out, recompute)
    kept = tuple(c for c in (*keep, "productive") if c in out.columns)
    out = collapse(out, keep=kept) if collapsed else out
    return add_locus(normalize(out, keep=kept, recompute=not own))


def read_parquet(spark: SparkSession, paths: Paths, *, keep: tuple[str, ...] = (), recompute: bool = True) -> DataFrame:
    """Stored clonotypes under any of their names; lists of calls stay whole, a missing count is one read."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.withColumn("_file", _sample_of_file(df))
    _needed(df, ALIASES, ("junction_aa",), "parquet")
    out = _aliased(df, keep, numbers=False)
    return add_locus(normalize(out, keep=tuple(c for c in (*keep, "productive") if c in out.columns), recompute=not _keep_frequency(out, recompute)))


def _export(spark: SparkSession, paths: Paths, kind: str, limit: int | None) -> DataFrame:
    """A tool's table under the standard names: the first call of each list without its allele, junctions in capitals, whole counts."""
    names = EXPORTS[kind]
    df = _table(spark, paths, limit=limit, names=names)
    _needed(df, names, tuple(c for c in names if c not in ("d_call", "c_call")), kind)
    calls = [extract_vdj(_named(df, c, names.get(c, ()))).alias(c) for c in ("v_call", "d_call", "j_call", "c_call")]
    nt = F.upper(_named(df, "junction_nt", names["junction_nt"]))
    aa = _named(df, "junction_aa", names["junction_aa"]) if "junction_aa" in names else unified_cdr3aa(translate_junction(nt))
    count = to_int(_named(df, "duplicate_count", names["duplicate_count"])) if "duplicate_count" in names else F.lit(1).cast("long")
    return df.select(F.col("_file").alias(SAMPLE), *calls, nt.alias("junction_nt"), aa.alias("junction_aa"), count.alias("duplicate_count"))


def read_mixcr(spark: SparkSession, paths: Paths, *, limit: int | None = None) -> DataFrame:
    """Clone tables of either header dialect; residues as they are."""
    return finalize(_export(spark, paths, "mixcr", limit))


def _unified(df: DataFrame) -> DataFrame:
    return df.withColumn("junction_aa", unified_cdr3aa(F.col("junction_aa")))


def read_migec(spark: SparkSession, paths: Paths, *, limit: int | None = None) -> DataFrame:
    return finalize(_unified(_export(spark, paths, "migec", limit)))


def read_mitcr(spark: SparkSession, paths: Paths, *, limit: int | None = None) -> DataFrame:
    return finalize(_unified(_export(spark, paths, "mitcr", limit)))


def read_rtcr(spark: SparkSession, paths: Paths, *, limit: int | None = None) -> DataFrame:
    """Tables without residues: junctions are translated."""
    return finalize(_export(spark, paths, "rtcr", limit))


def read_imgt(spark: SparkSession, paths: Paths, *, limit: int | None = None) -> DataFrame:
    """Summaries with one row for each read: genes without species, plain bases only."""
    df = _export(spark, paths, "imgt", limit).where("junction_nt rlike '^[ACGT]+$'")
    return finalize(df.withColumns({c: imgt_gene(F.col(c)) for c in ("v_call", "d_call", "j_call")}))


def read_trust4(spark: SparkSession, paths: Paths, *, limit: int | None = None) -> DataFrame:
    """Reports; junctions of other letters than bases (partial, out of frame) are left out."""
    return finalize(_unified(_export(spark, paths, "trust4", limit).where("junction_nt rlike '^[ACGT]+$'")))


def read_arda(spark: SparkSession, paths: Paths, **options) -> DataFrame:
    """Rearrangement tables in which a pair of quotes stands for no call."""
    df = read_airr(spark, paths, **options)
    return df.withColumns({c: F.when(F.trim(F.translate(c, '"', "")) != "", F.col(c)) for c in ("d_call", "c_call")})


def _adaptive(df: DataFrame, gene: tuple[str, ...], names: DataFrame | None) -> Column:
    """The first of gene, family and tied families that has a name: by the table of names if there is one, else ``TCR`` to ``TR`` without zeros."""
    rewritten = lambda c: F.when(F.lower(extract_vdj(c)) != "unresolved", F.regexp_replace(F.regexp_replace(extract_vdj(c), "TCR", "TR"), "0([1-9])", "$1"))
    known = {}
    if names is not None:  # a table of some hundred gene names
        known = {r[0]: r[1] for r in names.select("token", "gene").where("gene is not null").collect()}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else None

    def one(c: Column) -> Column:
        token = F.element_at(F.split(F.trim(F.translate(F.element_at(F.split(c, ","), 1), '"', "")), r"\*"), 1)
        return F.coalesce(table[token], rewritten(c)) if table is not None else rewritten(c)

    return F.coalesce(*(one(_column(df, c)) for c in gene))


def read_immunoseq(spark: SparkSession, paths: Paths, *, names: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Tables of either version: the junction is cut from the read by place and length; residues of the file count where it says in frame.

    ``names``: optional table ``token, gene`` of the vendor's gene names, as no rule decides whether a number is a gene or an allele.
    """
    df = _table(spark, paths, limit=limit)
    second = bool({"count (templates/reads)", "aminoacid"} & set(df.columns))
    pick = (lambda *c: _column(df, *c)) if second else None
    genes = {s: tuple(f"{s}{x}" for x in (("genename", "familyname", "familyties") if second else ("_gene", "_family", "_family_ties"))) for s in "vdj"}
    if second:
        count, full, aa, frame, size, at = to_int(pick("count (templates/reads)", "count")), pick("nucleotide"), pick("aminoacid"), pick("sequencestatus"), pick("cdr3length"), pick("vindex")
        needed = {"count": ("count (templates/reads)", "count"), "read": ("nucleotide",), "length": ("cdr3length",), "place": ("vindex",), "v": ("vgenename",), "j": ("jgenename",)}
    else:
        count, full, aa, frame, size, at = to_int(_column(df, "templates"), _column(df, "reads")), _column(df, "rearrangement"), _column(df, "amino_acid"), _column(df, "frame_type"), _column(df, "cdr3_length"), _column(df, "v_index")
        needed = {"count": ("templates",), "read": ("rearrangement",), "length": ("cdr3_length",), "place": ("v_index",), "v": ("v_gene",), "j": ("j_gene",)}
    _needed(df, needed, tuple(needed), "immunoseq")
    start, length = at.try_cast("int"), size.try_cast("int")
    nt = F.when((start >= 0) & (length > 0), F.upper(F.substring(full, start + 1, length)))
    residues = F.when((F.lower(F.trim(frame)) == "in") & aa.isNotNull(), unified_cdr3aa(aa)).otherwise(unified_cdr3aa(translate_junction(nt)))
    return finalize(df.select(F.col("_file").alias(SAMPLE), *(_adaptive(df, genes[s], names).alias(f"{s}_call") for s in "vdj"), nt.alias("junction_nt"), residues.alias("junction_aa"), count.alias("duplicate_count")))


def read_vidjil(spark: SparkSession, paths: Paths, *, sample_id: int = 0) -> DataFrame:
    """Clone files (JSON): the junction is cut from the sequence by its 1-based place; counts are those of one of the file's samples.

    A clone with fewer samples fails the job. Calls are names, or objects with a name.
    """
    seg = "struct<`5`: string, `4`: string, `3`: string, junction: struct<start: int, stop: int, aa: string>>"
    df = spark.read.schema(f"clones array<struct<sequence: string, reads: array<bigint>, seg: {seg}>>").json(paths, multiLine=True)
    c = df.select(_sample_of_file(df).alias(SAMPLE), F.explode("clones").alias("c")).where("c.seg is not null and c.seg.junction is not null")
    start, stop = F.col("c.seg.junction.start"), F.col("c.seg.junction.stop")
    reads = F.coalesce("c.reads", F.array(F.lit(0).cast("long")))
    count = F.when(F.size(reads) > sample_id, F.get(reads, F.lit(sample_id))).otherwise(F.raise_error(F.concat(F.lit(f"sample {sample_id} is out of range: a clone has "), F.size(reads).cast("string"), F.lit(" samples"))).cast("long"))
    call = lambda x: extract_vdj(F.when(F.col(f"c.seg.`{x}`").startswith("{"), F.get_json_object(f"c.seg.`{x}`", "$.name")).otherwise(F.col(f"c.seg.`{x}`")))
    out = c.select(
        SAMPLE, call("5").alias("v_call"), call("4").alias("d_call"), call("3").alias("j_call"), unified_cdr3aa(F.col("c.seg.junction.aa")).alias("junction_aa"),
        F.upper(F.substring(F.col("c.sequence"), start, stop - start + 1)).alias("junction_nt"), count.alias("duplicate_count"),
    )
    return finalize(out)


def sniff_format(spark: SparkSession, path: str) -> str:
    """The kind of a file, from its name or its first line."""
    name = path.lower()
    if name.endswith((".parquet", ".pq")):
        return "parquet"
    line = spark.read.text(path).limit(1).first()
    head = line[0] if line else ""
    if name.endswith((".vidjil", ".json")) or head.lstrip().startswith("{"):
        return "vidjil"
    has = {c.strip().lstrip("#").strip().lower() for c in head.split("\t")}
    standard = has & {"v_call", "junction_aa", "junction", "cdr3_aa"}
    rules = [
        ("imgt", {"v-gene and allele", "junction"} <= has), ("migec", {"cdr3 nucleotide sequence", "v segments"} <= has), ("mitcr", {"read.count", "cdr3.nucleotide.sequence"} <= has),
        ("rtcr", {"number of reads", "junction nucleotide sequence"} <= has), ("mixcr", bool(has & set(EXPORTS["mixcr"]["v_call"])) and bool(has & set(EXPORTS["mixcr"]["junction_nt"]))),
        ("immunoseq", "count (templates/reads)" in has or {"rearrangement", "amino_acid", "v_gene"} <= has), ("trust4", {"cid_full_length", "cdr3nt"} <= has), ("airr_cell", "cell_id" in has and bool(standard)),
        ("arda", "d2_call" in has and bool(standard)), ("native", "cdr3aa" in has or {"count", "cdr3nt"} <= has), ("airr", bool(standard) or "junction_nt" in has),
    ]
    found = next((kind for kind, ok in rules if ok), None)
    if found is None:
        raise ValueError(f"{path}: unknown kind of clonotype table, with the columns {', '.join(sorted(has))}")
    return found


def read(spark: SparkSession, paths: Paths, fmt: str = "auto", *, keep: tuple[str, ...] = (), recompute: bool = True) -> DataFrame:
    """Clonotypes of files of one kind; a table of cells is refused, as its cells would be pooled."""
    kind = sniff_format(spark, paths if isinstance(paths, str) else paths[0]) if fmt == "auto" else fmt
    if kind == "airr_cell":
        raise ValueError("a table with a cell_id column: read it by read_airr_cell, or as airr to pool its cells")
    if kind in ("native", "airr", "parquet"):
        return {"native": read_native, "airr": read_airr, "parquet": read_parquet}[kind](spark, paths, keep=keep, recompute=recompute)
    plain = {"mixcr": read_mixcr, "migec": read_migec, "mitcr": read_mitcr, "rtcr": read_rtcr, "imgt": read_imgt, "trust4": read_trust4, "arda": read_arda, "immunoseq": read_immunoseq, "vidjil": read_vidjil}
    if kind not in plain:
        raise ValueError(f"unknown kind {kind!r}")
    return plain[kind](spark, paths)


def read_samples(spark: SparkSession, metadata: DataFrame, base: str, *, sample: str = SAMPLE, template: str = "{sample}.tsv.gz", fmt: str = "auto", add_metadata: bool = True) -> DataFrame:
    """The files of all samples of a metadata table in one scan, ``file_name``, and the samples' metadata beside the clonotypes.

    The driver holds the list of files, as every scan does.
    """
    names = [r[0] for r in metadata.select(sample).distinct().collect()]
    paths = [f"{base.rstrip('/')}/{template.format(sample=n)}" for n in names]
    files = metadata.sparkSession.createDataFrame([(n, p.rsplit("/", 1)[-1]) for n, p in zip(names, paths, strict=True)], f"_name string, file_name string")
    stem = F.regexp_extract("file_name", r"^(.+?)(?:\.(?:txt|tsv|csv|json|vidjil|parquet|pq|gz|bz2|zst))*$", 1)
    got = read(spark, paths, fmt).withColumnRenamed(SAMPLE, "_stem").join(files.withColumn("_stem", stem), "_stem").drop("_stem").withColumnRenamed("_name", SAMPLE)
    if not add_metadata:
        return got
    extra = [c for c in metadata.columns if c != sample and c not in got.columns]
    return got.join(metadata.select(F.col(sample).alias(SAMPLE), *extra), SAMPLE, "left")


def map_samples(df: DataFrame, fn, schema: str, *, sample: str = SAMPLE) -> DataFrame:
    """``fn`` (pandas frame to pandas frame) on each sample by itself, in parallel; for what no DataFrame operator does."""
    return df.groupBy(sample).applyInPandas(fn, schema)


#: The columns of a table of cells.
CELL_COLUMNS = ("cell_id", "sequence_id", "locus", "v_call", "d_call", "j_call", "c_call", "junction_aa", "junction_nt", "duplicate_count", "umi_count", "clone_id", "productive")


def _cell_columns(df: DataFrame) -> DataFrame:
    names = {c: (c,) for c in CELL_COLUMNS} | {"cell_id": ("cell_id", "barcode"), "junction_nt": ("junction", "junction_nt", "cdr3_nt"), "junction_aa": ("junction_aa", "cdr3_aa"), "duplicate_count": ("duplicate_count", "consensus_count", "reads"), "umi_count": ("umi_count", "umis")}
    whole = ("duplicate_count", "umi_count")
    locus = F.coalesce(_column(df, "locus"), F.substring(_column(df, "v_call"), 1, 3))
    columns = {c: _column(df, *names[c]) for c in CELL_COLUMNS} | {"locus": locus, "productive": truthy(_column(df, "productive"))}
    return df.select(*(count_of(x.cast("string")).alias(c) if c in whole else x.alias(c) for c, x in columns.items()), F.xxhash64(columns["cell_id"], columns["sequence_id"]).alias("ord"))


def read_airr_cell(spark: SparkSession, paths: Paths) -> DataFrame:
    """Rearrangement tables with cells: one row for each contig."""
    df = _table(spark, paths)
    _needed(df, {"cell_id": ("cell_id", "barcode")}, ("cell_id",), "airr_cell")
    return _cell_columns(df).where("cell_id is not null")


def to_airr(cells: DataFrame) -> DataFrame:
    """Contigs of cells as a rearrangement table; a contig without a name is numbered within its cell."""
    nth = F.row_number().over(Window.partitionBy("cell_id").orderBy("ord"))
    name = F.coalesce(F.col("sequence_id"), F.concat_ws("_contig_", "cell_id", nth.cast("string")))
    letter = F.when(F.col("productive"), "T").when(~F.col("productive"), "F")
    return cells.select(
        "cell_id", name.alias("sequence_id"), F.lit("").alias("sequence"), "locus", letter.alias("productive"), "v_call", "d_call", "j_call", "c_call", F.col("junction_nt").alias("junction"), "junction_aa",
        F.col("duplicate_count").alias("consensus_count"), F.col("umi_count").alias("umi_count"), "clone_id",
    )


def from_airr(df: DataFrame) -> DataFrame:
    """The contigs of cells of a rearrangement table."""
    return _cell_columns(df)


def write_airr(cells: DataFrame, path: str) -> None:
    to_airr(cells).write.csv(path, sep="\t", header=True)


def write_cells(cells: DataFrame, path: str, *, fmt: str = "airr") -> None:
    """Contigs for other tools: as a rearrangement table, or as contig annotations."""
    if fmt == "airr":
        return write_airr(cells, path)
    if fmt != "10x":
        raise ValueError(f"fmt must be 'airr' or '10x', not {fmt!r}")
    yes = lambda c: F.when(c, "True").otherwise("False")
    out = cells.select(
        F.col("cell_id").alias("barcode"), F.lit("True").alias("is_cell"), F.col("sequence_id").alias("contig_id"), F.lit("True").alias("high_confidence"), F.col("locus").alias("chain"),
        *(F.col(f"{s}_call").alias(f"{s}_gene") for s in "vdjc"), F.lit("True").alias("full_length"), yes(F.col("productive")).alias("productive"), F.col("junction_aa").alias("cdr3"), F.col("junction_nt").alias("cdr3_nt"),
        F.col("duplicate_count").alias("reads"), F.col("umi_count").alias("umis"), F.col("clone_id").alias("raw_clonotype_id"),
    )
    out.write.csv(path, header=True)


def read_fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """``header, sequence`` of sequence files."""
    parts = spark.read.text(paths, lineSep=">").where("trim(value) != ''")
    lines = F.split("value", r"\r?\n")
    return parts.select(F.trim(lines[0]).alias("header"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", "").alias("sequence"))


def read_contigs(spark: SparkSession, paths: Paths) -> DataFrame:
    """Single-cell contig annotations (CSV): confident contigs of cells, with reads and molecules."""
    df = _table(spark, paths, ",", '"')
    kept = df.where(truthy(F.col("is_cell")) & truthy(F.col("high_confidence")))
    return kept.select(
        F.col("barcode").alias("cell_id"), F.col("contig_id").alias("sequence_id"), F.col("chain").alias("locus"), *(F.col(f"{s}_gene").alias(f"{s}_call") for s in "vdjc"),
        F.col("cdr3").alias("junction_aa"), F.col("cdr3_nt").alias("junction_nt"), F.col("reads").try_cast("long").alias("duplicate_count"), F.col("umis").try_cast("long").alias("umi_count"),
        F.col("raw_clonotype_id").alias("clone_id"), truthy(F.col("productive")).alias("productive"), F.xxhash64("barcode", "contig_id").alias("ord"),
    )


def read_metadata(spark: SparkSession, paths: Paths, sample: str = "sample_name") -> DataFrame:
    """Sample metadata, all text; ``nan`` is null."""
    df = _table(spark, paths)
    return df.select(F.col(sample).alias(SAMPLE), *(F.when(F.lower(c) != "nan", F.col(c)).alias(c) for c in df.columns if c not in (sample, "_file")))


def write_cohort(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet folders by a hash of the sample: a sample is in one folder, and so many samples make no small files."""
    part = F.pmod(F.xxhash64(SAMPLE), F.lit(buckets)).cast("int")
    df.withColumn("part", part).repartition("part", SAMPLE).sortWithinPartitions(SAMPLE).write.partitionBy("part").parquet(path)


def read_cohort(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """The cohort, or some samples: a filter that Parquet statistics serve, as files are sorted by sample."""
    df = spark.read.parquet(path)
    return (df.where(F.col(SAMPLE).isin(samples)) if samples is not None else df).drop("part")


def write_native(df: DataFrame, path: str) -> None:
    """One folder of tab-separated text for each sample."""
    out = recompute_frequency(df).select(
        SAMPLE, F.col("duplicate_count").alias("count"), F.col("frequency").alias("freq"), F.col("junction_nt").alias("cdr3nt"), F.col("junction_aa").alias("cdr3aa"),
        *(F.coalesce(f"{s}_call", F.lit(".")).alias(s) for s in "vdj"),
    )
    out.write.partitionBy(SAMPLE).csv(path, sep="\t", header=True)
