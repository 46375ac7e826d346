"""What a task reads must not follow the size of the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedgewood.operators import state
from sedgewood.plans import catalog


def most_read(spark, run) -> int:
    """The largest number of exchanged records that a task of run() reads."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    last = sc._gateway.new_array(jvm.double, 1)
    last[0] = 1.0

    def stages() -> dict:
        found = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    before = set(stages())
    run()
    read = [store.taskSummary(i, s.attemptId(), last) for i, s in stages().items() if i not in before and s.shuffleReadRecords()]
    return int(max(r.get().shuffleReadMetrics().readRecords().apply(0) for r in read))


def tables(spark, path: str, n: int) -> str:
    """n lines of n / 20 parts and n / 200 suppliers, each pair once."""
    parts, suppliers = n // 20, n // 200
    spark.range(n).select((F.col("id") % parts).alias("l_partkey"), ((F.col("id") % parts + F.floor(F.col("id") / parts) * 5) % suppliers).alias("l_suppkey")).write.parquet(f"{path}/lineitem.parquet")
    spark.range(parts).select(F.col("id").alias("p_partkey")).write.parquet(f"{path}/part.parquet")
    spark.range(suppliers).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey"), F.lit("s").alias("s_name")).write.parquet(f"{path}/supplier.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), (F.col("id") % 5).cast("int").alias("n_regionkey"), F.lit("n").alias("n_name")).write.parquet(f"{path}/nation.parquet")
    return path


@pytest.mark.parametrize("name", ["supernode_vote", "neighbours_capped"])
def test_links_dealt_by_size(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(state, "TASK_ROWS", 5000, raising=False)
    run = catalog.queries()[name]
    # a broadcast would hide what a larger table meets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = [most_read(spark, run(spark, tables(spark, f"{tmp_path}/{n}", n)).collect) for n in (20_000, 80_000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert read[1] < 1.5 * read[0]
