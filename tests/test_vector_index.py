from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sedgewood.operators import retrieval as R, vector_index as V
from sedgewood.plans import retrieval_queries as Q


def recall(got, exact):
    a, b = ({(r["query_id"], r["id"]) for r in df.select("query_id", "id").collect()} for df in (got, exact))
    return len(a & b) / len(b)


def test_recall_and_pruning(spark, tmp_path):
    corpus, queries = Q.vectors(spark, "/root/testdata/sf0.1")
    index = V.build(corpus, str(tmp_path / "i"))
    exact = R.dense_topk(corpus, queries, 5)
    probes = index.probes(Q.RECALL)
    assert probes < len(index.centroids) and index.probes(0.5) < probes
    assert index.rows(spark).count() == corpus.count()
    stored = V.load(spark, str(tmp_path / "i"))
    assert (stored.centroids == index.centroids).all() and (stored.recall == index.recall).all()
    assert recall(V.search(stored, queries, 5, probes), exact) >= 0.9
    every = V.search(stored, queries, 5, len(index.centroids))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    one = V.search(stored, queries.limit(1), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0], plan
    assert len(one.select("id").join(index.rows(spark), "id").select("cell").distinct().collect()) <= 2


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    index = V.build(corpus, str(tmp_path / "i"))
    probes, queries = index.probes(0.95), corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    assert probes <= len(index.centroids) // 5
    assert recall(V.search(index, queries, 5, probes), R.dense_topk(corpus, queries, 5)) >= 0.9


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(200)] + [(400, [0.0] * 8), (401, None), (402, [0.0] * 8)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("cell", F.lit("x")).repartition(5)
    queries = spark.createDataFrame([(1, rows[3][1]), (2, rows[9][1]), (3, None), (4, [0.0] * 8)], "query_id long, vector array<double>")
    # fitted on a few rows, all are indexed
    index = V.build(corpus, str(tmp_path / "i"), cells=6, sample=40)
    assert index.rows(spark).count() == 262
    got = V.search(index, queries, 7, len(index.centroids))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.dense_topk(corpus, queries.where("vector is not null"), 7).collect()))
    ids = [r["id"] for r in V.search(index, queries, 7, 1).where("query_id = 1").orderBy("rank").collect()]
    assert ids == [3, *range(100, 106)]
    empty = V.build(corpus.limit(0), str(tmp_path / "none"))
    assert V.search(empty, queries, 3, 2).count() == 0 and V.search(index, queries.limit(0), 3, 2).count() == 0
