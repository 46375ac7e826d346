"""Queries over scans, sinks and keyed updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgewood.functions.text import label_name
from sedgewood.operators.graph_build import corrupt_lines, merge_property_nodes
from sedgewood.operators.jobs import upsert
from sedgewood.plans.registry import query, table
from sedgewood.sources.readers import merge_pages
from sedgewood.sources.writers import graph_fragments


@query("SELECT doc_id, text, source, n_chars FROM documents WHERE trim(text) <> ''")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full scan of a collection without blank rows."""
    return table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", "text", "source", "n_chars")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def merged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a file joined in page order; conversations are the files, their turns the pages."""
    return merge_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations WHERE turn >= 1 AND turn < 3 GROUP BY conv_id")
def merged_scan_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a range of pages, its end excluded."""
    return merge_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 1, 3)


@query("""SELECT c.conv_id, c.n_turns, e.n_events FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) AS c
JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id) AS e ON c.conv_id = e.user_id""")
def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that have both kinds of files; conversations and users with events stand for them."""
    left = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    right = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.count("*").alias("n_events"))
    return left.join(right, "conv_id").select("conv_id", "n_turns", "n_events")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 11 <> 0")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, broken ones left out; every eleventh line is broken on purpose."""
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("value"))
    return lines.where(F.try_parse_json("value").isNotNull()).select("event_id", F.from_json("value", "k long")["k"].alias("k"))


@query("SELECT event_id, '{' || props AS value FROM events WHERE event_id % 11 = 0")
def jsonl_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken lines of the same scan."""
    return corrupt_lines(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("value")))


@query("SELECT user_id AS key, CAST(ordinality - 1 AS BIGINT) AS idx, item AS content FROM (SELECT user_id, unnest(list_sort(list_distinct(list(event_type)))) AS item, generate_subscripts(list_sort(list_distinct(list(event_type))), 1) AS ordinality FROM events GROUP BY user_id)")
def json_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and items of JSON lists."""
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("body"))
    return lists.select(F.col("user_id").alias("key"), F.posexplode(F.from_json("body", "array<string>")).alias("idx", "content")).select("key", F.col("idx").cast("long").alias("idx"), "content")


@query("SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY event_type")
def summary_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of a JSON map."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("string").alias("n"))
    one = counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("body"))
    return one.select(F.explode(F.from_json("body", "map<string,string>")).alias("key", "value"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins: open orders are the table, the others the update."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return upsert(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus <> 'O'"), "o_custkey", "o_orderkey")


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(p_brand, '[^\\p{L}\\p{N}_]', '', 'g'), ''), 'Entity') AS label,
coalesce(nullif(upper(regexp_replace(p_type, '[^\\p{L}\\p{N}_]', '', 'g')), ''), 'RELATED_TO') AS rel FROM part""")
def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and relationship types made safe."""
    return table(spark, sf_dir, "part").select("p_partkey", label_name(F.col("p_brand"), "Entity").alias("label"), label_name(F.col("p_type"), "RELATED_TO", True).alias("rel"))


@query("""SELECT o_custkey, max(CASE WHEN r = 1 THEN o_orderstatus END) AS status, max(CASE WHEN p = 1 THEN o_orderpriority END) AS priority FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r,
 CASE WHEN o_orderpriority <> '5-LOW' THEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority <> '5-LOW' ORDER BY o_orderkey DESC) END AS p FROM orders) GROUP BY o_custkey""")
def property_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged property maps of a node's versions; an order of low priority does not set the priority."""
    props = F.when(F.col("o_orderpriority") == "5-LOW", F.create_map(F.lit("status"), "o_orderstatus")).otherwise(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"))
    merged = merge_property_nodes(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", props.alias("props")), "o_custkey", "o_orderkey")
    return merged.select("o_custkey", F.try_element_at("props", F.lit("status")).alias("status"), F.try_element_at("props", F.lit("priority")).alias("priority"))


@query("""SELECT 'nodes' AS section, '<node id="N' || n_nationkey || '" label="' || n_name || '"/>' AS value FROM nation UNION ALL
SELECT 'edges', '<edge source="N' || n_nationkey || '" target="R' || n_regionkey || '"/>' FROM nation""")
def gexf_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a GEXF file."""
    n = table(spark, sf_dir, "nation")
    key = F.concat(F.lit("N"), "n_nationkey")
    return graph_fragments(n.select(key.alias("id"), F.col("n_name").alias("label")), n.select(key.alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst")))


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS value FROM nation")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a Markdown report."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name"), F.lit(" |")).alias("value"))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_nationkey < 20 THEN c_nationkey END, -1) AS community FROM customer")
def community_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node to community, -1 where it has none."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")), F.lit(-1)).alias("community"))
