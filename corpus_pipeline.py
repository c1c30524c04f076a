"""A training-data pipeline over ``documents``: five stages, each on all that the one before has kept.

Stages go by rows, not by ``doc_id``: what decides about a row is its source and text (quality), its id and text
(near copies), its text (secrets) or all of them (mixing), so that rows with null or repeated ids are neither lost nor kept
by another row's verdict.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from immunoframe.llm.mixing import mixed_rows
from immunoframe.llm.packing import pack
from immunoframe.llm.quality_lines import quality_rules, row_key
from immunoframe.llm.scratch import Scratch, whole_row
from immunoframe.llm.secret_forest import redact
from immunoframe.llm.setsketch import near_duplicates, text_key

#: The intermediate tables of the stages that have run, by the folder that they ran for.
_TABLES: dict[tuple[str, str], list[tuple[int, Scratch]]] = {}


def _scratch(spark: SparkSession, docs: DataFrame, sf_dir: str, stage: str) -> Scratch:
    """Tables for a stage. Those of the stages before it go, as their results have been written and ``docs`` reads them from there."""
    at = [name for name, _ in STAGES].index(stage)
    held = _TABLES.setdefault((spark.sparkContext.applicationId, sf_dir), [])
    earlier = [x for x in held if x[0] < at]
    files = docs.inputFiles() if earlier else []
    for old in earlier:
        if not any(old[1].base in f for f in files):
            old[1].close()
            held.remove(old)
    held.append((at, Scratch(spark, f"pipeline-{stage}")))
    return held[-1][1]


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def _without(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the column ``key`` of ``keys``."""
    rows = docs.select(whole_row(docs).alias("given"), key.alias("key"))
    return rows.join(keys, "key", "left_anti").select("given.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = quality_rules(docs, with_keys=True, scratch=_scratch(spark, docs, sf_dir, "quality_rules"))
    return _without(docs, judged.where("not kept").select(F.col("of").alias("key")).distinct(), row_key(F.col("source"), F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (sets of five-word shingles, similarity from 0.8 on) stays.

    A row without an id counts under an id of its text that is larger than any given one; of rows that are equal in id
    and text one stays.
    """
    scratch = _scratch(spark, docs, sf_dir, "near_dedup")
    text = F.col("text").cast("string")
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftright(F.xxhash64(text), 2).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    key = F.struct(own.alias("doc_id"), text_key(text).alias("of"))
    judged = near_duplicates(docs.select(own.alias("doc_id"), text.alias("text")), k=5, percent=80, with_keys=True, scratch=scratch)
    judged = judged.select(F.struct("doc_id", "of").alias("key"), "kept")
    left = _without(docs, judged.where("not kept").select("key").distinct(), key)
    repeated = scratch.cut(judged.where("kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if repeated.isEmpty():
        return left
    rows = left.select(whole_row(left).alias("given"), key.alias("key"))
    once = rows.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return rows.join(repeated, "key", "left_anti").unionByName(once).select("given.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked; every document stays."""
    return _sized(redact(docs, path="source", scratch=_scratch(spark, docs, sf_dir, "secret_scan"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs, scratch=_scratch(spark, docs, sf_dir, "mixing"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), scratch=_scratch(spark, docs, sf_dir, "packing"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mixing), ("packing", packing),
]

#: SQL can express neither the forest of the third stage nor the sketches and packing of the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, f"pipeline-{name}-out")
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if last is not None:
            last.close()
        last = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
