"""Clonotype views over the driver's tables: one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row for each line item: 20 samples, tied and allele-marked V calls, two loci, some unproductive junctions.
READS = """
select concat('S', lpad(cast(l_suppkey % 20 as string), 2, '0')) as sample_id,
  case when l_partkey % 5 = 0 then concat('IGHV', cast(1 + l_partkey % 7 as string), '*0', cast(1 + l_linenumber % 2 as string))
    else concat('TRBV', cast(1 + l_partkey % 30 as string), '*0', cast(1 + l_linenumber % 2 as string),
      case when l_partkey % 7 = 0 then concat(', TRBV', cast(1 + (l_partkey + 11) % 30 as string), '*01') else '' end) end as v_call,
  case when l_partkey % 3 = 0 then null when l_partkey % 5 = 0 then 'IGHD1*01' else concat('TRBD', cast(1 + l_partkey % 2 as string)) end as d_call,
  case when l_partkey % 5 = 0 then concat('IGHJ', cast(1 + l_partkey % 6 as string), '*01')
    else concat('TRBJ', cast(1 + l_partkey % 2 as string), '-', cast(1 + l_partkey % 7 as string), '*01') end as j_call,
  case when l_partkey % 5 = 0 then case l_orderkey % 4 when 0 then 'IGHM' when 1 then 'IGHG1*01' when 2 then 'IGHA2' else null end end as c_call,
  concat('CASS', substr(translate(md5(cast(l_partkey % 1200 as string)), '0123456789abcdef', 'ADEFGHIKLNPQRSTV'), 1, cast(4 + l_partkey % 6 as int)),
    case when l_partkey % 11 = 0 then '*' when l_partkey % 13 = 0 then '_' else '' end, 'F') as junction_aa,
  substr(translate(md5(cast(l_orderkey % 900 as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(24 + 3 * (l_partkey % 3) as int)) as junction_nt,
  cast(l_quantity as bigint) as duplicate_count,
  case when l_partkey % 5 = 0 then (80 + l_orderkey % 21) / 100.0e0 end as v_identity,
  cast(l_orderkey * 10 + l_linenumber as bigint) as ord
from lineitem
"""

#: One row for each clonotype of a sample, with its frequency there.
_GROUPED = """
  select sample_id, v_call, min(d_call) as d_call, j_call, min(c_call) as c_call, junction_aa, junction_nt,
    cast(sum(duplicate_count) as bigint) as duplicate_count, max(v_identity) as v_identity, min(ord) as ord
  from reads group by sample_id, v_call, j_call, junction_aa, junction_nt"""
CLONOTYPES = f"""
select *, cast(duplicate_count as double) / sum(duplicate_count) over (partition by sample_id) as frequency from ({_GROUPED})
"""

#: Sample metadata.
SAMPLES = """
select distinct concat('S', lpad(cast(s_suppkey % 20 as string), 2, '0')) as sample_id,
  case when s_suppkey % 20 % 3 = 0 then '+' when s_suppkey % 20 = 19 then null else '-' end as cmv,
  concat('B', cast(s_suppkey % 20 % 4 as string)) as batch, concat('A*0', cast(1 + s_suppkey % 20 % 3 as string), ':01') as hla_1,
  case when s_suppkey % 20 % 5 = 0 then null else concat('A*0', cast(1 + s_suppkey % 20 % 2 as string), ':02') end as hla_2
from supplier
"""

#: Single-cell contigs: users are cells.
CELLS = """
select concat('cell', cast(user_id as string)) as cell_id, concat('contig', cast(event_id as string)) as sequence_id,
  case event_id % 5 when 0 then 'TRA' when 1 then 'TRB' when 2 then 'IGK' when 3 then 'IGH' else 'TRA' end as locus,
  concat(case event_id % 5 when 0 then 'TRA' when 1 then 'TRB' when 2 then 'IGK' when 3 then 'IGH' else 'TRA' end, 'V', cast(1 + event_id % 9 as string), '*01') as v_call,
  concat(case event_id % 5 when 0 then 'TRA' when 1 then 'TRB' when 2 then 'IGK' when 3 then 'IGH' else 'TRA' end, 'J', cast(1 + event_id % 3 as string)) as j_call,
  concat('CA', substr(translate(md5(cast(event_id % 700 as string)), '0123456789abcdef', 'ADEFGHIKLNPQRSTV'), 1, 6), 'F') as junction_aa,
  cast(1 + event_id % 97 as bigint) as duplicate_count, cast(1 + event_id % 13 as bigint) as umi_count, event_id as ord
from events
"""

#: A germline library with faults: parts are alleles.
GERMLINE = """
select case when p_partkey % 50 = 0 then null else concat('TRB', substr('VDJ', cast(1 + p_partkey % 3 as int), 1), cast(p_partkey % 150 as string), case when p_partkey % 7 = 0 then '' else '*01' end) end as allele,
  case when p_partkey % 17 = 0 then 'Q' else substr('VDJ', cast(1 + p_partkey % 3 as int), 1) end as segment,
  case p_partkey % 13 when 0 then null when 1 then 'TGTNNN' when 2 then 'TGTGCCTTT' else substr(translate(md5(cast(p_partkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) end as sequence
from part
"""

#: A nucleotide junction with a substitution in some rows, and a junction cut short, so that near matches occur.
MUTATED = "case when ord % 7 = 0 then concat('A', substr(junction_nt, 2)) when ord % 11 = 0 then concat(substr(junction_nt, 1, 9), 'CC', substr(junction_nt, 12)) else junction_nt end"
SHORT = "concat('CASS', substr(junction_aa, 5, 5))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, name: str, sql: str) -> DataFrame:
    return df.sparkSession.sql(sql.replace(f"from {name}", "from {t}"), t=df)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), "lineitem", READS)


def clonotypes(spark: SparkSession, sf_dir: str, dealt: tuple[str, ...] = ()) -> DataFrame:
    """``CLONOTYPES`` with the samples' totals (a row for each) from the reads, so that no task sorts a sample.

    ``dealt``: columns of the clonotype by which rows are dealt, so that groups by them need no further shuffle.
    """
    rows = reads(spark, sf_dir)
    totals = rows.groupBy(F.col("sample_id").alias("_of")).agg(F.sum("duplicate_count").alias("_all"))
    grouped = _select(rows.repartition(*dealt) if dealt else rows, "reads", _GROUPED)
    held = grouped.join(F.broadcast(totals), F.col("sample_id").eqNullSafe(F.col("_of")))
    return held.select(*grouped.columns, (F.col("duplicate_count").cast("double") / F.col("_all")).alias("frequency"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "supplier"), "supplier", SAMPLES)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), "events", CELLS)


def germline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "part"), "part", GERMLINE)


def one(df: DataFrame, sample: str) -> DataFrame:
    return df.where(F.col("sample_id") == sample)


def oracle(body: str) -> str:
    """A DuckDB query over the views that ``body`` names."""
    views = (("reads", READS), ("clonotypes", CLONOTYPES), ("samples", SAMPLES), ("cells", CELLS), ("germline", GERMLINE))
    head = "with " + ", ".join(f"{n} as ({s.strip()})" for n, s in views)
    body = body.strip()
    return head + ("" if body.startswith(",") else " ") + body
