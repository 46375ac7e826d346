"""Readers of document, artifact, graph and result files, each a DataFrame of rows with an explicit schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

PAGES = "page_content string, source string, page int, filename string"


def read_paged(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[str]], pattern: str = "*.pdf") -> DataFrame:
    """One row for each non-blank page of each file; ``parse`` gives a file's pages.  Files it fails on have no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = list(parse(content))
                except Exception as error:  # a broken file must not end the scan
                    print(f"{name}: {error}")
                    continue
                rows = [(p, name, i, name.rsplit("/", 1)[-1]) for i, p in enumerate(pages, 1) if p and p.strip()]
                yield pd.DataFrame(rows, columns=["page_content", "source", "page", "filename"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, PAGES)


def merge_pages(pages: DataFrame, key: str, order: str, text: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """key, text, n_pages: a file's pages from ``start`` up to ``end`` (from 0, end excluded) joined by blank lines."""
    if start is not None:
        pages = pages.where(F.col(order) >= max(start, 0))
    if end is not None:
        pages = pages.where(F.col(order) < end)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n")
    return pages.groupBy(key).agg(joined.alias(text), F.count("*").alias("n_pages"))


def read_artifacts(spark: SparkSession, path: str, text_name: str, json_name: str, schema: str, prefix: str = "") -> DataFrame:
    """folder, text, tables of each folder with the prefix that has both files."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)

    def files(name: str) -> DataFrame:
        # other files and folders are left out when they are listed, so their contents are never read
        found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(f"{path}/{prefix}*")
        return found.select(folder.alias("folder"), F.col("content").cast("string").alias("body"))

    tables = files(json_name).select("folder", F.from_json("body", schema).alias("tables"))
    return files(text_name).withColumnRenamed("body", "text").join(tables, "folder")


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """idx, content of a file that is a JSON list of strings."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("x"))
    return body.select(F.posexplode("x").alias("idx", "content"))


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value of a file that is a JSON map."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("x"))
    return body.select(F.explode("x").alias("key", "value"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines that are JSON, and the lines that are not; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull()
    return lines.where(~bad).select(F.from_json("value", schema).alias("r")).select("r.*"), lines.where(bad)


def read_records(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Rows of a file that is a JSON list of objects, in file order, with their ordinal; all, or the first ones."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema}>>").alias("x"))
    rows = body.select(F.posexplode("x").alias("ordinal", "r")).select("ordinal", "r.*")
    return rows if limit is None else rows.where(F.col("ordinal") < limit)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, quoted line breaks, and perhaps a byte order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, label) and edges(source, target) of a GEXF file, with attribute values by their attribute's id."""
    attribute = "attvalues struct<attvalue:array<struct<_for:string,_value:string>>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, _label string, {attribute}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {attribute}").load(path)
    values = F.map_from_entries(F.transform(F.coalesce("attvalues.attvalue", F.array().cast("array<struct<_for:string,_value:string>>")), lambda a: F.struct(a["_for"], a["_value"]))).alias("attributes")
    return nodes.select(F.col("_id").alias("id"), F.col("_label").alias("label"), values), edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"), values)


def first_existing(df: DataFrame, *names: str) -> str:
    """The first of the names that df has as a column."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} in {df.columns}")
