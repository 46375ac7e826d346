"""Sharding by rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Every shard scores every key from a hash of both, ``-weight / ln(u)`` with u in (0, 1), and the best score wins.  A
record's shard depends on its key and the list of shards alone; a further shard takes only the records it wins.

Slots number a shard's records from 0 without gaps and without sorting a shard in one task: records are numbered
within a small part of their shard, and a part starts where the parts before it end.

Defined cases: a null text has no bytes; a null key is replaced by the text's checksum; repeated rows go to one shard
and get different slots; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedgewood.llm._state import settle

SHARDS, PARTS = 24, 1024


def unit(key: Column, salt: Column) -> Column:
    """A stable number in (0, 1) from the first 60 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), salt.cast("string")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 60)


def scores(key: Column, weights: list[float]) -> Column:
    """The shards' scores for a key as an array in shard order."""
    pairs = F.array(*(F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)))
    return F.transform(pairs, lambda x: F.struct((-x["weight"] / F.ln(unit(key, x["shard"]))).alias("score"), x["shard"].alias("shard")))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard if one more of ``grown_weight`` were there."""
    weights = weights or [1.0] * SHARDS
    n = len(weights)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc"), F.col("text_crc32").cast("string")))
    scored = slim.withColumn("key", key).withColumn("scores", scores(F.col("key"), [*weights, grown_weight]))
    best = F.array_max(F.slice("scores", 1, n))["shard"]
    rows = scored.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), best.alias("shard"), F.array_max("scores")["shard"].alias("grown_shard"),
        F.floor(unit(F.col("key"), F.lit("part")) * PARTS).cast("int").alias("part"),
    )
    return numbered(settle(rows), "shard", "part", [F.col("doc_id"), F.col("text_crc32"), F.col("size")]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def numbered(df: DataFrame, group: str, part: str, order: list[Column]) -> DataFrame:
    """df with ``slot``: 0, 1, ... within each group, by part and then by ``order``."""
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, part).agg(F.count("*").alias("slot_n"))
    starts = counts.select(group, part, F.coalesce(F.sum("slot_n").over(before), F.lit(0)).alias("slot_start"))
    within = Window.partitionBy(group, part).orderBy(*order)
    placed = df.withColumn("slot_place", F.row_number().over(within)).join(starts, [group, part])
    return placed.withColumn("slot", F.col("slot_start") + F.col("slot_place") - 1).drop("slot_place", "slot_start")


def _unit_sql(salt: str) -> str:
    return f"((('0x' || substr(md5(key || ':' || {salt}), 1, 15))::BIGINT)::DOUBLE + 0.5) / {float(1 << 60)}"


_PART = "'part'"
#: Checksums byte by byte, over a table made from the polynomial.
ASSIGN_SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS c, i, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, strlen(t) + 8 AS size, CASE WHEN x = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)), lambda a, b: xor(a // 256, tab[xor(a & 255, b) + 1])), 4294967295) END AS text_crc32 FROM d, tab),
k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'crc' || text_crc32) AS key FROM c),
s AS (SELECT *, list_transform(range({SHARDS + 1}), lambda s: -1.0 / ln({_unit_sql("s")})) AS sc, CAST(floor({_unit_sql(_PART)} * {PARTS}) AS BIGINT) AS part FROM k),
a AS (SELECT *, list_position(sc[1:{SHARDS}], list_max(sc[1:{SHARDS}])) - 1 AS shard, list_position(sc, list_max(sc)) - 1 AS grown_shard FROM s)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM a
"""
