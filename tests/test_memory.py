"""What Python workers hold must not follow the size of Spark's batches."""

from __future__ import annotations

import threading
import time

import psutil
import pytest
from pyspark.sql import functions as F

from sedgewood.functions import text
from sedgewood.operators import retrieval as R


def peak_mb(run) -> float:
    """The largest private memory of a Python worker while run() runs."""
    most, done = [0.0], threading.Event()

    def watch() -> None:
        while not done.is_set():
            for p in psutil.Process().children(recursive=True):
                try:
                    if "python" in p.name():
                        most[0] = max(most[0], p.memory_full_info().uss / 1e6)
                except psutil.Error:
                    continue
            time.sleep(0.02)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        run()
    finally:
        done.set()
        thread.join()
    return most[0]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_dense_search(spark, metric):
    vector = F.array(*(F.rand(i) for i in range(8))).alias("vector")
    corpus = spark.range(0, 20_000, 1, 1).select("id", vector)
    queries = spark.range(0, 3000, 1, 1).select(F.col("id").alias("query_id"), vector)
    # seed and place decide a row's vector, so each query is one of the first rows
    rows = []
    assert peak_mb(lambda: rows.extend(R.dense_topk(corpus, queries, 2, metric).where("rank = 1").collect())) < 400
    assert len(rows) == 3000 and all(r["id"] == r["query_id"] for r in rows)


def test_word_search(spark):
    corpus = spark.range(0, 20_000, 1, 1).select("id", F.concat(F.lit("w"), F.col("id") % 400).alias("text"))
    queries = spark.range(0, 400, 1, 1).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), "id").alias("text"))
    rows = []
    assert peak_mb(lambda: rows.extend(R.bm25_topk(corpus, queries, 1).collect())) < 150
    assert len(rows) == 400 and all(r["id"] == r["query_id"] for r in rows)


def test_encoder(spark):
    path = text.vocabulary()
    if path is None:
        pytest.skip("no vocabulary")
    texts = spark.range(0, 5000, 1, 1).select(F.when(F.col("id") != 7, F.repeat(F.concat(F.lit("some words "), "id", F.lit(" ")), 150)).alias("t"))
    rows = []
    assert peak_mb(lambda: rows.extend(texts.select(text.encoded_tokens(F.col("t"), path).alias("n")).collect())) < 400
    assert rows[7]["n"] is None and all(r["n"] >= 300 for i, r in enumerate(rows) if i != 7)


def test_embedder_of_many_words(spark):
    texts = spark.range(0, 4000, 1, 1).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.md5((F.col("id") * 300 + i).cast("string")))).alias("text"))
    rows = []
    assert peak_mb(lambda: rows.extend(R.hashed_vectors(texts, "id", "text").collect())) < 200
    assert all(sum(r["vector"]) == 300 for r in rows)
