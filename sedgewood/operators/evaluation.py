"""Scores of retrieval and answers."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from sedgewood.functions.models import Answerer, Judge
from sedgewood.functions.text import signature


def hit_and_rank(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, hit and reciprocal_rank: the first of hits(query_id, rank, content) with the signature of the query's truth."""
    asked = queries.select("query_id", signature(F.col("truth")).alias("sig"))
    found = hits.join(asked, "query_id").where(F.contains("content", "sig")).groupBy("query_id").agg(F.min("rank").alias("first"))
    out = queries.select("query_id").distinct().join(found, "query_id", "left")
    return out.select("query_id", F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def means(df: DataFrame, by: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """The mean of each column in each group, a missing value counting 0."""
    return df.groupBy(*by).agg(*(F.round(F.avg(F.coalesce(F.col(c), F.lit(0.0))), digits).alias(f"mean_{c}") for c in columns))


def precision_recall(hits: DataFrame, relevant: Column, n_relevant: DataFrame, k: int) -> DataFrame:
    """Share of the k hits that are relevant, and of the relevant ones found, for each query."""
    found = hits.groupBy("query_id").agg(F.count_if(relevant).alias("found"))
    return n_relevant.join(found, "query_id", "left").select("query_id", F.round(F.coalesce("found", F.lit(0)) / k, 6).alias("precision"), F.round(F.when(F.col("n_relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("n_relevant")).otherwise(0.0), 6).alias("recall"))


def merge_datasets(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Rows of all parts, the first of each key, in the order of the parts."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("part_no", F.lit(i).cast("long"))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    return every.withColumn("row_of_key", F.row_number().over(Window.partitionBy(key).orderBy("part_no", *order))).where("row_of_key = 1").drop("row_of_key")


def valid_answers(df: DataFrame, question: str, answer: str, evasive: list[str], least: int = 10) -> DataFrame:
    """Rows whose answer has no evasive phrase and whose question is long enough."""
    bad = F.lit(False)
    for p in evasive:
        bad |= F.contains(F.lower(answer), F.lit(p))
    return df.where(~F.coalesce(bad, F.lit(True)) & (F.length(question) >= least))


def judged(df: DataFrame, judges: dict[str, tuple[Judge, list[str]]]) -> DataFrame:
    """df with a score of each judge on its columns; null where the judge fails or a text is missing, which ``means`` counts as 0."""

    def scorer(judge: Judge):
        @pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            out: list[float | None] = []
            for texts in rows.itertuples(index=False):
                try:
                    out.append(None if any(t is None for t in texts) else float(judge(*texts)))
                except Exception:  # one row's failure is its own
                    out.append(None)
            return pd.Series(out, dtype="float64")

        return score

    for name, (judge, columns) in judges.items():
        df = df.withColumn(name, scorer(judge)(F.struct(*columns)))
    return df


def run_modes(questions: DataFrame, modes: dict[str, Answerer], question: str = "question") -> DataFrame:
    """A row for each question and mode: questions' columns with mode, answer, error and latency in seconds.

    A question on which a mode fails has no answer but the error's text, and does not end the run.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in questions.schema.fields)}, mode string, answer string, error string, latency double"

    def one(mode: str, answer: Answerer) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for text in batch[question]:
                    start, found, error = time.perf_counter(), None, None
                    try:
                        found = answer(text)
                    except Exception as e:  # kept with its question
                        error = f"{type(e).__name__}: {e}"
                    rows.append((mode, found, error, time.perf_counter() - start))
                yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=["mode", "answer", "error", "latency"])], axis=1)

        return questions.mapInPandas(run, schema)

    out = None
    for mode, answer in modes.items():
        own = one(mode, answer)
        out = own if out is None else out.unionByName(own)
    return out
