"""A round of moves must not deal the links again for each thing it wants to know of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgewood.operators import leiden as L


def written(spark, run) -> int:
    """How many records the stages of run() write for exchanges."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def stages() -> dict:
        found = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    before = set(stages())
    run()
    return sum(n for i, n in stages().items() if i not in before)


def test_links_of_a_round(spark):
    n = 60_000
    # few nodes, so that nearly all that is written is links
    links = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("src"), (500 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500))).alias("dst"), F.lit(1.0).alias("weight")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a broadcast would hide what a larger table meets
    try:
        edges = L.stored(links)
        state, n = L.stored(L.singles(edges)), edges.count()
        # half of the links' ends are dealt twice, and a quarter of the links twice for the check of the round
        assert written(spark, lambda: L.local_moving(edges, state, rounds=1).count()) < 2 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_states_judged_together(spark):
    edges = L.stored(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (4, 4, 1.0)], "src long, dst long, weight double"))
    one = L.singles(edges)
    two = one.withColumn("community", F.when(F.col("id") < 3, 1).otherwise(3).cast("long"))
    assert L.qualities(L.joined(edges, one, two), [one, two]) == [L.quality(edges, one), L.quality(edges, two)]
