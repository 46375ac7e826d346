"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns
of ``documents``; the last returns the packed pieces.  ``run`` writes each stage's result to the shared folder and
reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgewood.llm import decontamination, packing, quality_rules, simhash, substring_dedup
from sedgewood.llm._state import checkpoint_folder
from sedgewood.llm.queries import TOKENIZERS, table, with_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing and boilerplate lines."""
    return quality_rules.clean_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies, of five-word similarity 0.8 or more."""
    with_package(spark)
    return simhash.dedup_stage(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that an earlier document has."""
    with_package(spark)
    return substring_dedup.dedup_stage(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its words or with other parameters."""
    return decontamination.decontaminate_stage(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    with_package(spark)
    return packing.pack(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("quality_rules", quality), ("simhash_near_dup", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontaminated), ("best_fit_packing", packed)]

#: Tokens and fingerprints are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's table goes once the next one's is written; only the last stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
