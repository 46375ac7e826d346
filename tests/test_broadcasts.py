"""What the driver sends to all executors must not follow the size of the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedgewood.operators import graph_retrieval as G


def most_sent(spark, run) -> int:
    """The largest number of rows that run() broadcasts at once."""
    jvm = spark.sparkContext._jvm
    java = jvm.scala.jdk.javaapi.CollectionConverters.asJava
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in java(store.executionsList())}
    run()
    sent = [0]
    for e in java(store.executionsList()):
        values = java(store.executionMetrics(e.executionId())) if e.executionId() not in before else {}
        for node in java(store.planGraph(e.executionId()).allNodes()) if values else ():
            if "BroadcastExchange" in node.name():
                sent += [int(values[m.accumulatorId()].replace(",", "")) for m in java(node.metrics()) if m.name() == "number of output rows" and m.accumulatorId() in values]
    return max(sent)


@pytest.fixture
def nodes(spark, tmp_path):
    """Names whose file is far smaller than they and their pieces are."""
    spark.range(0, 60_000, 1, 4).select(F.concat(F.lit("P"), "id").alias("id")).write.parquet(f"{tmp_path}/nodes")
    return spark.read.parquet(f"{tmp_path}/nodes")


def test_entry_points(spark, nodes):
    targets = spark.createDataFrame([(1, "p 77"), (2, "5999"), (3, "none"), (4, "")], "query_id long, target string")
    rows = []
    assert most_sent(spark, lambda: rows.extend(G.entry_points(targets, nodes).collect())) < 5000
    found = {q: [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3, 4)}
    assert found == {1: ["P77"], 2: sorted(f"P{i}" for i in range(60_000) if "5999" in str(i))[:10], 3: [], 4: []}


def test_first_match(spark, nodes):
    targets = spark.createDataFrame([(1, "P77"), (2, "5999"), (3, "xp12345y"), (4, "none")], "query_id long, target string")
    rows = []
    assert most_sent(spark, lambda: rows.extend(G.first_match(targets, nodes.withColumn("ordinal", F.col("id"))).collect())) < 5000
    assert {r["query_id"]: r["id"] for r in rows} == {1: "P77", 2: min(f"P{i}" for i in range(60_000) if "5999" in str(i)), 3: "P1"}
