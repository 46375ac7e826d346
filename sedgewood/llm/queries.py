"""The registered query of each operator of this subpackage, with production parameters over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sedgewood.llm import decontamination, filter_audit, html_extraction, importance, packing, phrases, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, toxicity, url_filters

ROOT = str(Path(__file__).resolve().parents[2])

#: Folder of the public tokenizers' vocabularies; ``SEDGEWOOD_TOKENIZERS`` names another.
TOKENIZERS = os.environ.get("SEDGEWOOD_TOKENIZERS") or str(Path(public_tokenizers.path("word_bpe_49k.json")).parent)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where the driver found it; on a cluster, ship it with --py-files."""
    seen = spark.sparkContext.environment
    if ROOT not in seen.get("PYTHONPATH", "").split(os.pathsep):
        seen["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, seen.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


@query
def op7_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_substring_dedup"] = substring_dedup.DIGEST_SQL
ORACLE_SQL["op2_quality_rules"] = quality_rules.JUDGE_SQL
ORACLE_SQL["op3_suffix_dedup"] = suffix_dedup.DIGEST_SQL
ORACLE_SQL["op9_rendezvous_shards"] = sharding.ASSIGN_SQL


@query
def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


ORACLE_SQL["op4_url_filters"] = url_filters.judge_sql()


@query
def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_phrase_collocations"] = phrases.COLLOCATIONS_SQL


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE_SQL["op12_filter_audit"] = filter_audit.AUDIT_SQL


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
