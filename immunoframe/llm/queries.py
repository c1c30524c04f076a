"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .heavy_light import ngram_join
from .html_crf import extract
from .licenses import license_scan
from .mih import nearest
from .mixing import mix
from .oracles import ORACLE_SQL
from .packing import pack
from .quality_lines import quality_rules
from .secret_forest import scan
from .setsketch import near_duplicates
from .sharding import shard
from .spelling import group_variants, word_counts
from .url_templates import url_filter
from .va_file import hard_negatives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path="source")
    return found.select("row.doc_id", F.col("word").cast("long").alias("word"), F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("digest"), F.round("score", 6).alias("score"), "secret")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(_table(spark, sf_dir, "documents"), typo_every=31))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2, what the rules say: the columns that SQL can express."""
    out = url_filter(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3, the base."""
    return license_scan(_table(spark, sf_dir, "documents")).drop("labels", "score")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6, the sizes."""
    return shard(_table(spark, sf_dir, "documents")).select("doc_id", "size", "law")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10, the targets."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_extraction, op2_url_filter, op3_license_scan, op4_secret_scan, op5_nearest_neighbours, op6_sampled_splitters, op7_best_fit_packing, op8_minhash_near_dedup, op9_quality_rules, op10_mixing, op11_hard_negatives, op12_ngram_join, op13_spelling_variants, url_rules, license_base, shard_sizes, mixing_targets)}

__all__ = ["ORACLE_SQL", "QUERIES"]
