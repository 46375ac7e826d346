"""Queries over the graph of suppliers, parts, nations and regions, and over the extractions it comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sedgewood.functions import models as M
from sedgewood.operators import graph_analytics as A, graph_build as B, graph_retrieval as G, leiden, retrieval as R
from sedgewood.operators.state import settle, stored, tasks
from sedgewood.plans.registry import query, table

# --- the graph -------------------------------------------------------------------------------------------------------

_NODES = """nodes AS (SELECT 'S' || s_suppkey AS id, 'SUPPLIER' AS type, s_name AS description FROM supplier UNION ALL SELECT 'P' || p_partkey, 'PART', p_name FROM part
UNION ALL SELECT 'N' || n_nationkey, 'NATION', n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, 'REGION', r_name FROM region)"""
_EDGES = """edges AS (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, 'SUPPLIES' AS relation, '' AS description, l_partkey * 100000 + l_suppkey AS edge_seq FROM lineitem
UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'LOCATED_IN', s_name, s_suppkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF', n_name, n_nationkey FROM nation)"""
_BOTH = "both_ways AS (SELECT src, dst, relation, description, edge_seq FROM edges UNION ALL SELECT dst, src, relation, description, edge_seq FROM edges WHERE src <> dst)"


def key(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("id"), F.lit("SUPPLIER").alias("type"), F.col("s_name").alias("description")),
        table(spark, sf_dir, "part").select(key("P", "p_partkey").alias("id"), F.lit("PART").alias("type"), F.col("p_name").alias("description")),
        table(spark, sf_dir, "nation").select(key("N", "n_nationkey").alias("id"), F.lit("NATION").alias("type"), F.col("n_name").alias("description")),
        table(spark, sf_dir, "region").select(key("R", "r_regionkey").alias("id"), F.lit("REGION").alias("type"), F.col("r_name").alias("description")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks(table(spark, sf_dir, "lineitem").count())  # counted by the files' footers


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts and suppliers of lines, dealt by part, so that neither a task's rows nor their keys grow with the table."""
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition(line_tasks(spark, sf_dir), "l_partkey")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("").alias("description")
    supplies = dealt_lines(spark, sf_dir).distinct()
    return (
        supplies.select(key("P", "l_partkey").alias("src"), key("S", "l_suppkey").alias("dst"), F.lit("SUPPLIES").alias("relation"), none, (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("edge_seq"))
        .unionByName(table(spark, sf_dir, "supplier").select(key("N", "s_nationkey").alias("src"), key("S", "s_suppkey").alias("dst"), F.lit("LOCATED_IN").alias("relation"), F.col("s_name").alias("description"), F.col("s_suppkey").alias("edge_seq")))
        .unionByName(table(spark, sf_dir, "nation").select(key("N", "n_nationkey").alias("src"), key("R", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("relation"), F.col("n_name").alias("description"), F.col("n_nationkey").cast("long").alias("edge_seq")))
    )


# --- extractions -----------------------------------------------------------------------------------------------------

_LINES = "ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS pos FROM lineitem)"
_SEQ = "l_orderkey * 1000 + pos"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w)).withColumn("seq", F.col("l_orderkey") * 1000 + F.col("pos"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line for each order: its suppliers as entities and its supplies as relationships, half of them as tool calls
    and half as fenced content; every tenth has another status, and some lines are broken."""
    entity = F.struct(key("S", "l_suppkey").alias("name"), F.when(F.col("l_returnflag") != "A", F.lit("SUPPLIER")).alias("type"), F.col("l_linestatus").alias("description"))
    relation = F.struct(key("S", "l_suppkey").alias("source"), key("P", "l_partkey").alias("target"), F.lit("SUPPLIES").alias("relation_type"), F.col("l_returnflag").alias("description"))
    grouped = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", entity.alias("e"), relation.alias("r")))).alias("x"))
    payload = F.to_json(F.struct(F.transform("x", lambda x: x["e"]).alias("entities"), F.transform("x", lambda x: x["r"]).alias("relationships")))
    odd = F.col("l_orderkey") % 2 == 1
    call = F.struct(F.struct(F.lit("GraphExtraction").alias("name"), payload.alias("arguments")).alias("function"))
    message = F.struct(F.when(~odd, F.concat(F.lit("```json\n"), payload, F.lit("\n```"))).alias("content"), F.when(odd, F.array(call)).alias("tool_calls"))
    status = F.when(F.col("l_orderkey") % 10 == 7, 500).otherwise(200)
    line = F.to_json(F.struct(F.concat(F.lit("order_"), "l_orderkey").alias("custom_id"), F.struct(status.alias("status_code"), F.struct(F.array(F.struct(message.alias("message"))).alias("choices")).alias("body")).alias("response")))
    return grouped.select(F.when(F.col("l_orderkey") % 13 == 5, F.concat(F.lit("{"), line)).otherwise(line).alias("value"))


_GOOD = "l_orderkey % 10 <> 7 AND l_orderkey % 13 <> 5"


@query(f"WITH {_LINES} SELECT 'order_' || l_orderkey AS custom_id, CAST(pos - 1 AS BIGINT) AS pos, 'S' || l_suppkey AS name, CASE WHEN l_returnflag <> 'A' THEN 'SUPPLIER' END AS type, l_linestatus AS description FROM ln WHERE {_GOOD}")
def parse_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the parsed responses."""
    return B.entity_rows(B.parse_responses(responses(spark, sf_dir))).select("custom_id", F.col("pos").cast("long").alias("pos"), "name", "type", "description")


@query(f"WITH {_LINES} SELECT 'order_' || l_orderkey AS custom_id, 'S' || l_suppkey AS source, 'P' || l_partkey AS target, l_returnflag AS description FROM ln WHERE {_GOOD} AND l_orderkey % 2 = 1")
def parse_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships from tool calls alone."""
    calls = responses(spark, sf_dir).where("value not like '%```json%'")
    return B.relation_rows(B.parse_responses(calls)).select("custom_id", "source", "target", "description")


@query(f"WITH {_LINES} SELECT 'order_' || l_orderkey AS custom_id, count(*) AS n_entities, count(*) AS n_relationships FROM ln WHERE {_GOOD} GROUP BY l_orderkey")
def concat_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads put together for each document."""
    return B.concat_extractions(B.parse_responses(responses(spark, sf_dir)), "custom_id")


def entity_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("seq", key("S", "l_suppkey").alias("name"), F.when(F.col("l_returnflag") != "A", F.lit("SUPPLIER")).alias("type"), F.col("l_linestatus").alias("description"))


def relation_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("seq", key("S", "l_suppkey").alias("source"), key("P", "l_partkey").alias("target"), F.concat(F.lit("SUPPLIES_"), "l_returnflag").alias("relation"), F.col("l_linestatus").alias("description"))


_ENT = f"SELECT {_SEQ} AS seq, 'S' || l_suppkey AS name, CASE WHEN l_returnflag <> 'A' THEN 'SUPPLIER' ELSE 'UNKNOWN' END AS type, l_linestatus AS description FROM ln"


@query(f"WITH {_LINES}, e AS ({_ENT}) SELECT name, arg_min(type, seq) AS type, arg_min(description, seq) AS description FROM e GROUP BY name")
def nodes_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, the first mention counts."""
    return B.upsert_nodes(entity_seq(spark, sf_dir))


@query(f"WITH {_LINES}, e AS ({_ENT}) SELECT name, arg_max(type, seq) AS type, arg_max(description, seq) AS description FROM e GROUP BY name")
def nodes_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, the last mention counts."""
    return B.upsert_nodes(entity_seq(spark, sf_dir), wins="last")


@query(f"WITH {_LINES}, e AS ({_ENT} UNION ALL SELECT {_SEQ} + 1000000000, 'P' || l_partkey, 'UNKNOWN', '' FROM ln) SELECT name, arg_min(type, seq) AS type, arg_min(description, seq) AS description FROM e GROUP BY name")
def nodes_with_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, with the endpoints that no entity named."""
    later = relation_seq(spark, sf_dir).withColumn("seq", F.col("seq") + 1000000000)
    return B.upsert_nodes(entity_seq(spark, sf_dir), later)


@query(f"WITH {_LINES} SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, 'SUPPLIES_' || arg_max(l_returnflag, {_SEQ}) AS relation, arg_max(l_linestatus, {_SEQ}) AS description FROM ln GROUP BY l_partkey, l_suppkey")
def edges_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One undirected edge a pair, the last attributes."""
    return B.collapse_edges(relation_seq(spark, sf_dir))


@query("SELECT 'S' || l_suppkey || '-SUPPLIES_' || l_returnflag || '-P' || l_partkey AS edge_id, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag, l_partkey")
def edge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges by source, relation and target."""
    rel = relation_seq(spark, sf_dir)
    return rel.groupBy("source", "relation", "target").agg(F.count("*").alias("n")).select(F.concat_ws("-", "source", "relation", "target").alias("edge_id"), "n")


@query("SELECT 'S' || l_suppkey AS name, '[' || string_agg(DISTINCT '\"order_' || l_orderkey || '\"', ',' ORDER BY '\"order_' || l_orderkey || '\"') || ']' AS source_chunk_ids FROM lineitem GROUP BY l_suppkey")
def provenance_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks each node comes from."""
    return B.provenance(table(spark, sf_dir, "lineitem").select(key("S", "l_suppkey").alias("name"), key("order_", "l_orderkey").alias("chunk")), ["name"], "chunk")


@query(f"WITH {_NODES} SELECT id, id || ' (' || type || '): ' || description AS text FROM nodes")
def verbalise_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as sentences to embed."""
    return nodes(spark, sf_dir).select("id", B.node_text(F.col("id"), F.col("type"), F.col("description")).alias("text"))


@query(f"WITH {_EDGES} SELECT src, dst, src || ' -[' || relation || ']-> ' || dst || ': ' || description AS text FROM edges")
def verbalise_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as sentences to embed."""
    return edges(spark, sf_dir).select("src", "dst", B.edge_text(F.col("src"), F.col("relation"), F.col("dst"), F.col("description")).alias("text"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def gleaning_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further rounds of extraction add what is new: one round for each return flag."""
    li = table(spark, sf_dir, "lineitem")
    rounds = [li.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey") for f in ("A", "N", "R")]
    return B.glean(rounds[0].distinct(), rounds[1:], ["l_partkey", "l_suppkey"])


_NAMES = "regexp_extract_all(text, '[\\p{Lu}][\\p{L}]{3,}', 0)"
_FOUND = f"f AS (SELECT doc_id, {_NAMES} AS n FROM documents)"


@query(f"WITH {_FOUND} SELECT doc_id AS chunk_id, i - 1 AS pos, name FROM (SELECT doc_id, unnest(n) AS name, generate_subscripts(n, 1) AS i FROM f)")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by the default extractor."""
    return M.extract_names(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))[0].select("chunk_id", "pos", "name")


@query(f"WITH {_FOUND} SELECT doc_id AS chunk_id, i - 1 AS pos, n[i] AS source, n[i + 1] AS target FROM (SELECT doc_id, n, unnest(range(1, greatest(len(n), 1))) AS i FROM f) WHERE n[i] <> n[i + 1]")
def extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by the default extractor."""
    return M.extract_names(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))[1].select("chunk_id", "pos", "source", "target")


@query("SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS target FROM benchmark")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of queries by the default finder."""
    return M.query_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


# --- analytics -------------------------------------------------------------------------------------------------------

_DEGREES = "deg AS (SELECT id, count(x) AS degree FROM nodes LEFT JOIN (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) ON id = x GROUP BY id)"
_COMP = """cc(id, root) AS (SELECT id, id FROM nodes UNION SELECT b.dst, cc.root FROM cc JOIN both_ways AS b ON cc.id = b.src)"""


@query(f"WITH {_NODES}, {_EDGES}, {_DEGREES} SELECT id, degree FROM deg")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees."""
    return A.degrees(nodes(spark, sf_dir), edges(spark, sf_dir))


_SMALL_N = "nodes AS (SELECT 'C' || c_custkey AS id FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier UNION ALL SELECT 'N' || n_nationkey FROM nation)"
_SMALL_E = "edges AS (SELECT 'N' || c_nationkey AS src, 'C' || c_custkey AS dst FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)"


def accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, suppliers and nations; those in credit belong to their nation."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    ids = c.select(key("C", "c_custkey").alias("id")).union(s.select(key("S", "s_suppkey"))).union(n.select(key("N", "n_nationkey")))
    links = c.where("c_acctbal > 0").select(key("N", "c_nationkey").alias("src"), key("C", "c_custkey").alias("dst")).union(s.where("s_acctbal > 0").select(key("N", "s_nationkey"), key("S", "s_suppkey")))
    return ids, links


@query(f"WITH {_SMALL_N}, {_SMALL_E}, r AS (SELECT src AS nation, min(least(src, dst)) AS root FROM edges GROUP BY src) SELECT id, coalesce(a.root, b.root, id) AS component FROM nodes LEFT JOIN r AS a ON id = a.nation LEFT JOIN edges ON id = dst LEFT JOIN r AS b ON src = b.nation")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a graph of stars and single nodes."""
    return A.components(*accounts(spark, sf_dir))


@query("SELECT 'V' || p_partkey AS id, min('V' || p_partkey) OVER (PARTITION BY p_partkey // 50) AS component FROM part")
def components_of_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of chains of fifty nodes, every second one closed to a ring, some links turned round or twice."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    last = F.col("k") % 50 == 49
    ahead = p.join(p.select((F.col("k") - 1).alias("k")), "k").where(~last)
    ways = ahead.select(key("V", "k").alias("src"), F.concat(F.lit("V"), F.col("k") + 1).alias("dst"))
    rings = p.where("k % 100 = 49").select(key("V", "k").alias("src"), F.concat(F.lit("V"), F.greatest(F.col("k") - 49, F.lit(1))).alias("dst"))
    turned = ways.where("src < dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return A.components(p.select(key("V", "k").alias("id")), ways.unionByName(rings).unionByName(turned))


@query(f"WITH {_NODES} SELECT id, (SELECT min(id) FROM nodes) AS component FROM nodes WHERE id IN (SELECT 'S' || s_suppkey FROM supplier UNION SELECT 'P' || l_partkey FROM lineitem UNION SELECT 'N' || s_nationkey FROM supplier UNION SELECT 'R' || n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey))")
def giant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of the smallest node of the whole graph."""
    comp = A.components(nodes(spark, sf_dir), edges(spark, sf_dir))
    return comp.join(comp.agg(F.min("component").alias("component")), "component", "left_semi").select("id", "component")


@query(f"""WITH {_SMALL_N}, {_SMALL_E}, {_DEGREES}, c AS (SELECT src AS k, count(*) + 1 AS n FROM edges GROUP BY src UNION ALL SELECT id, 1 FROM deg WHERE degree = 0),
h AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m, (SELECT count(*) FROM deg WHERE degree = 0) AS isolates, (SELECT count(*) FROM deg WHERE degree = 1) AS leaves, (SELECT count(*) FROM c) AS components, (SELECT max(n) FROM c) AS giant)
SELECT n, m, round(2.0 * m / n, 6)::DOUBLE AS avg_degree, round(2.0::DOUBLE * m / (n * (n - 1.0::DOUBLE)), 9) AS density, isolates, leaves, components, giant, round(100.0 * giant / n, 6)::DOUBLE AS giant_percent,
CASE WHEN 100.0 * giant / n < 10 THEN 'critical' WHEN 100.0 * giant / n < 50 THEN 'warning' ELSE 'good' END AS connectivity, CASE WHEN 100.0 * isolates / n > 10 THEN 'warning' ELSE 'good' END AS isolation FROM h""")
def graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, density and soundness of a graph."""
    ids, links = accounts(spark, sf_dir)
    return A.health(ids, links, A.components(ids, links))


@query(f"WITH {_NODES}, {_EDGES} SELECT 'v1' AS graph, (SELECT count(*) FROM nodes) AS n, count(*) AS m, round(2.0::DOUBLE * count(*) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0::DOUBLE)), 9) AS density FROM edges UNION ALL SELECT 'v2', (SELECT count(*) FROM nodes WHERE type <> 'PART'), count(*), round(2.0::DOUBLE * count(*) / ((SELECT count(*) FROM nodes WHERE type <> 'PART') * ((SELECT count(*) FROM nodes WHERE type <> 'PART') - 1.0::DOUBLE)), 9) FROM edges WHERE relation <> 'SUPPLIES'")
def density_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of two graphs side by side."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    out = None
    for name, a, b in (("v1", n, e), ("v2", n.where("type <> 'PART'"), e.where("relation <> 'SUPPLIES'"))):
        row = a.agg(F.count("*").alias("n")).join(b.agg(F.count("*").alias("m")), how="cross").select(F.lit(name).alias("graph"), "n", "m", F.round(2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1.0)), 9).alias("density"))
        out = row if out is None else out.unionByName(row)
    return out


_ASSIGN = "asg AS (SELECT 'S' || s_suppkey AS id, 'N' || s_nationkey AS community FROM supplier UNION ALL SELECT 'P' || p_partkey, p_brand FROM part)"


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation and parts by brand."""
    return table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("id"), key("N", "s_nationkey").alias("community")).union(table(spark, sf_dir, "part").select(key("P", "p_partkey"), "p_brand"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dealt_lines(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight"))
    return pairs.select(key("P", "l_partkey").alias("src"), key("S", "l_suppkey").alias("dst"), "weight")


_SUPPLY = "sup AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL)"


@query(f"WITH {_ASSIGN}, {_SUPPLY} SELECT least(a.community, b.community) AS src, greatest(a.community, b.community) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM sup JOIN asg AS a ON a.id = src JOIN asg AS b ON b.id = dst WHERE a.community <> b.community GROUP BY ALL")
def coarsen_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights between communities."""
    return A.coarsen(supply_edges(spark, sf_dir), assignment(spark, sf_dir))


@query("""WITH sp AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), v AS (SELECT l_partkey, lv, community, count(*) AS n FROM (SELECT l_partkey, 3 AS lv, 'N' || s_nationkey AS community FROM sp JOIN supplier ON s_suppkey = l_suppkey
UNION ALL SELECT l_partkey, 2, 'R' || n_regionkey FROM sp JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, lv ORDER BY n DESC, community) AS r FROM v)
SELECT 'P' || p_partkey AS id, CAST(level AS BIGINT) AS level, coalesce(community, 'L0_0') AS community FROM (SELECT p_partkey, unnest([2, 3]) AS level FROM part) LEFT JOIN b ON l_partkey = p_partkey AND lv = level AND r = 1""")
def supernode_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts placed by the majority of their suppliers, on two levels."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    known = s.select(key("S", "s_suppkey").alias("id"), F.lit(3).cast("long").alias("level"), key("N", "s_nationkey").alias("community")).union(s.select(key("S", "s_suppkey"), F.lit(2).cast("long"), key("R", "n_regionkey")))
    return A.vote(table(spark, sf_dir, "part").select(key("P", "p_partkey").alias("id")), supply_edges(spark, sf_dir), known, line_tasks(spark, sf_dir))


@query("SELECT c_custkey AS id, l3, coalesce(l2, l3) AS l2, coalesce(l1, l2, l3) AS l1, coalesce(l0, l1, l2, l3) AS l0 FROM (SELECT c_custkey, 'N' || c_nationkey AS l3, CASE WHEN c_custkey % 2 = 0 THEN 'R' || (c_nationkey % 5) END AS l2, CASE WHEN c_custkey % 3 = 0 THEN 'W' END AS l1, CAST(NULL AS VARCHAR) AS l0 FROM customer)")
def hierarchy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing levels take the next finer one."""
    c = table(spark, sf_dir, "customer")
    levels = c.select(F.col("c_custkey").alias("id"), key("N", "c_nationkey").alias("l3"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string"))).alias("l2"), F.when(F.col("c_custkey") % 3 == 0, F.lit("W")).alias("l1"), F.lit(None).cast("string").alias("l0"))
    return A.fill_levels(levels, ["l3", "l2", "l1", "l0"])


@query("""WITH x AS (SELECT 'nation' AS level, c_nationkey AS c, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 'region', n_regionkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)
SELECT level, count(*) AS communities, round(sum(n)::DOUBLE / count(*), 6) AS avg_size, max(n) AS largest, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) AS sizes FROM x GROUP BY level""")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sizes of communities on each level."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = c.select(F.lit("nation").alias("level"), F.col("c_nationkey").alias("c")).union(c.select(F.lit("region"), "n_regionkey")).groupBy("level", "c").agg(F.count("*").alias("n"))
    return x.groupBy("level").agg(F.count("*").alias("communities"), F.round(F.sum("n").cast("double") / F.count("*"), 6).alias("avg_size"), F.max("n").alias("largest"), F.array_join(F.sort_array(F.collect_list("n"), False).cast("array<string>"), ",").alias("sizes"))


@query("SELECT p_brand AS community, count(*) AS n, CASE WHEN count(*) < 2 THEN 'single node' ELSE string_agg('P' || p_partkey, ',' ORDER BY 'P' || p_partkey) END AS members FROM part GROUP BY p_brand")
def community_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each community, a fixed text for single nodes."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("community")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key("P", "p_partkey"))).alias("m"))
    return g.select("community", "n", F.when(F.col("n") < 2, "single node").otherwise(F.array_join("m", ",")).alias("members"))


_REGIONAL = "ra AS (SELECT 'S' || s_suppkey AS id, 'R' || n_regionkey AS community FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'P' || p_partkey, 'R' || (p_partkey % 5) FROM part)"


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(key("S", "s_suppkey").alias("id"), key("R", "n_regionkey").alias("community")).union(table(spark, sf_dir, "part").select(key("P", "p_partkey"), F.concat(F.lit("R"), (F.col("p_partkey") % 5).cast("string"))))


@query(f"""WITH {_REGIONAL}, {_SUPPLY}, inn AS (SELECT src, dst FROM sup JOIN ra AS a ON a.id = src JOIN ra AS b ON b.id = dst WHERE a.community = b.community),
d AS (SELECT id, community, count(x) AS inner_degree FROM ra LEFT JOIN (SELECT src AS x FROM inn UNION ALL SELECT dst FROM inn) ON id = x GROUP BY ALL)
SELECT id, community, inner_degree FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY inner_degree DESC, id) AS r FROM d) WHERE r <= 20""")
def induced_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best connected members of each community."""
    return A.top_members(regional(spark, sf_dir), supply_edges(spark, sf_dir), 20)


@query("""WITH n AS (SELECT 'R' || r_regionkey AS community, string_agg('- N' || n_nationkey || ' (NATION): ' || n_name, chr(10) ORDER BY 'N' || n_nationkey) AS e FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey)
SELECT community, 'Community ID: ' || community || chr(10) || chr(10) || 'Entities:' || chr(10) || e AS text FROM n""")
def community_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities as text for a summariser."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("- N"), "n_nationkey", F.lit(" (NATION): "), "n_name")
    g = n.groupBy(key("R", "r_regionkey").alias("community")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key("N", "n_nationkey").alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("e"))
    return g.select("community", F.concat(F.lit("Community ID: "), "community", F.lit("\n\nEntities:\n"), "e").alias("text"))


@query("SELECT p_brand AS community, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def communities_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities from the largest."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("community")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "community")).cast("long"))


@query("""SELECT level, community, count(*) AS n FROM (SELECT 'l3' AS level, CAST(c_nationkey AS VARCHAR) AS community FROM customer UNION ALL SELECT 'l2', CAST(CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_nationkey % 5 END AS VARCHAR) FROM customer) WHERE community <> '-1' GROUP BY ALL""")
def multilevel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of communities of all levels, nodes without one left out."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("l3"), F.when(F.col("c_custkey") % 4 == 0, -1).otherwise(F.col("c_nationkey") % 5).cast("string").alias("l2"))
    return c.unpivot(["c_custkey"], ["l3", "l2"], "level", "community").where("community <> '-1'").groupBy("level", "community").agg(F.count("*").alias("n"))


@query()
def communities_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat communities of suppliers and nations and customers, by modularity."""
    ids, links = accounts(spark, sf_dir)
    found = A.communities(links, levels=2, rounds=5)
    return ids.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


@query()
def communities_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities on four levels by the constant Potts model, limited in size."""
    _, links = accounts(spark, sf_dir)
    return A.hierarchy(links, [0.1, 0.2, 0.3, 0.4], [10, 20, 100, None])


def supply_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supply edges with numbers for ids, even ones for parts: half the space of names wherever links are dealt."""
    pairs = dealt_lines(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight"))
    return pairs.select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"), "weight")


_SUPPLY_IDS = "SELECT 'P' || l_partkey AS id FROM lineitem UNION SELECT 'S' || l_suppkey FROM lineitem"


@query(f"SELECT count(*) AS placed, 0::BIGINT AS in_pieces, true AS above_floor FROM ({_SUPPLY_IDS})")
def leiden_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat communities of parts and suppliers, judged: nodes placed, communities that are not connected, and whether their
    modularity is above two thirds of that of parts put with the supplier they have most lines with."""
    e = stored(supply_numbers(spark, sf_dir))
    found = leiden.leiden(e, levels=2, rounds=10)
    best = e.groupBy("src").agg(F.max_by("dst", F.struct("weight", "dst")).alias("community"))
    stars = best.select(F.col("src").alias("id"), "community").union(e.select("dst", "dst").distinct())
    strength = stored(leiden.singles(e).select("id", "k", "size"))
    states = [stored(strength.join(x, "id")) for x in (found, stars)]
    ends = stored(leiden.joined(e, *states))  # links meet their ends once for all that is judged
    values = leiden.qualities(ends, states)
    parts = A.components(found.select("id"), ends.where("a0 = b0")).join(found, "id")
    pieces = stored(parts.groupBy(F.col("community").alias("whole")).agg(F.count_distinct("component").alias("n")))
    placed = found.join(strength, "id", "left_semi").agg(F.count_distinct("id").alias("placed"))
    return placed.join(pieces.agg(F.count_if(F.col("n") > 1).alias("in_pieces")), how="cross").withColumn("above_floor", F.lit(3 * values[0] >= 2 * values[1]))  # two single rows


@query(f"SELECT count(*) AS placed, true AS within_limits, true AS only_filled_go_on FROM ({_SUPPLY_IDS})")
def capped_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts and suppliers on three levels under size limits, judged: nodes placed on the finest level, no
    community above its limit, and only communities that fill nine tenths of it on the next level."""
    limits = {2: 10, 1: 20}
    e = stored(supply_numbers(spark, sf_dir))
    rows = settle(leiden.capped_hierarchy(e, [0.1, 0.2, 0.3], [10, 20, None], rounds=2))
    fine, upper = (rows.where(F.col("level") == n).select("id", F.col("community").alias(f"c{n}")) for n in (2, 1))
    size = fine.groupBy("c2").agg(F.count_distinct("id").alias("n"))
    went = fine.join(upper, "id").join(size, "c2")
    held = went.groupBy("c1").agg(F.count_distinct("c2").alias("n"))
    one = fine.agg(F.count_distinct("id").alias("placed"))
    checks = size.agg(F.max("n").alias("a")).join(held.agg(F.coalesce(F.max("n"), F.lit(0)).alias("b")), how="cross").join(went.agg(F.coalesce(F.min("n"), F.lit(limits[2])).alias("c")), how="cross")
    return one.join(checks, how="cross").select("placed", ((F.col("a") <= limits[2]) & (F.col("b") <= limits[1])).alias("within_limits"), (F.col("c") >= int(limits[2] * 0.9)).alias("only_filled_go_on"))  # single rows


@query(f"WITH {_NODES}, {_EDGES}, {_DEGREES} SELECT id, type, description, degree, true AS known FROM deg JOIN nodes USING (id) WHERE id IN ('S1', 'P7', 'N3', 'R0', 'X1')")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups: attributes and degree of named nodes."""
    asked = spark.createDataFrame([(x,) for x in ("S1", "P7", "N3", "R0", "X1")], "id string")
    n = nodes(spark, sf_dir)
    return n.join(asked, "id", "left_semi").join(A.degrees(n, edges(spark, sf_dir)), "id").select("id", "type", "description", "degree", F.lit(True).alias("known"))


# --- retrieval from the graph ----------------------------------------------------------------------------------------

_TARGETS = "tg AS (SELECT n_nationkey AS query_id, unnest(['n ' || n_nationkey, 'region' || n_regionkey, 'P' || n_nationkey || '0']) AS target FROM nation)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation: its own name in another spelling, a region's, and a part's."""
    n = table(spark, sf_dir, "nation")
    names = F.array(F.concat(F.lit("n "), "n_nationkey"), F.concat(F.lit("region"), "n_regionkey"), F.concat(F.lit("P"), "n_nationkey", F.lit("0")))
    return n.select(F.col("n_nationkey").alias("query_id"), F.explode(names).alias("target"))


_ENTRY = """tt AS (SELECT DISTINCT query_id, replace(lower(target), ' ', '') AS t FROM tg), nn AS (SELECT id, replace(lower(id), ' ', '') AS n FROM nodes),
ex AS (SELECT query_id, t, id FROM tt JOIN nn ON t = n), fz AS (SELECT query_id, t, id FROM tt JOIN nn ON contains(n, t) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = tt.query_id AND ex.t = tt.t)),
ep AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM (SELECT DISTINCT query_id, id FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz))) WHERE rank <= 10)"""


@query(f"WITH {_NODES}, {_TARGETS}, {_ENTRY} SELECT query_id, id, rank FROM ep")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a query's names mean."""
    return G.entry_points(targets(spark, sf_dir), nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, {_TARGETS}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS ordinal FROM nodes), d AS (SELECT DISTINCT * FROM tg), ex AS (SELECT query_id, target, id FROM d JOIN o ON target = id)
SELECT * FROM ex UNION ALL SELECT query_id, target, arg_min(id, ordinal) FROM d JOIN o ON contains(lower(id), lower(target)) OR contains(lower(target), lower(id)) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = d.query_id AND ex.target = d.target) GROUP BY ALL""")
def entry_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first node that contains a name or that it contains."""
    # the ordinal is the order of ids
    return G.first_match(targets(spark, sf_dir), nodes(spark, sf_dir).withColumn("ordinal", F.col("id")))


_NEAR = f"{_BOTH}, nr AS (SELECT query_id, ep.id, dst AS neighbour, relation, b.description, row_number() OVER (PARTITION BY query_id, ep.id ORDER BY edge_seq, dst) AS r, count(*) OVER (PARTITION BY query_id, ep.id) AS n FROM ep JOIN both_ways AS b ON ep.id = b.src)"


@query(f"""WITH {_NODES}, {_EDGES}, {_TARGETS}, {_ENTRY}, {_NEAR}, l AS (SELECT query_id, id, max(n) AS n, string_agg('  - [' || relation || '] -> ' || neighbour || CASE WHEN description <> '' THEN chr(10) || '    (Details: ' || description || ')' ELSE '' END, chr(10) ORDER BY r) AS lines FROM nr WHERE r <= 20 GROUP BY query_id, id)
SELECT query_id, id, concat_ws(chr(10), 'ENTITY: ' || id || ' (' || type || ') - ' || description, CASE WHEN n > 20 THEN '    (Truncated ' || (n - 20) || ' other connections...)' END, lines) AS context FROM ep JOIN nodes USING (id) LEFT JOIN l USING (query_id, id)""")
def one_hop_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their first twenty connections."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return G.capped_context(stored(G.entry_points(targets(spark, sf_dir), n)), n, e)


@query(f"""WITH {_NODES}, {_EDGES}, {_TARGETS}, {_ENTRY}, {_NEAR}, c AS (SELECT query_id, string_agg(DISTINCT id || ' -[' || relation || ']-> ' || neighbour, chr(10) ORDER BY id || ' -[' || relation || ']-> ' || neighbour) AS c FROM nr GROUP BY query_id)
SELECT query_id, CASE WHEN length(c) > 16000 THEN substring(c, 1, 16000) || '...(truncated)' ELSE c END AS context FROM c""")
def one_hop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All connections of a query's nodes as distinct lines, cut at the budget."""
    # stored: where entries are known to be few, links need not be dealt to meet them
    return G.line_context(stored(G.entry_points(targets(spark, sf_dir), nodes(spark, sf_dir))), edges(spark, sf_dir))


@query(f"WITH {_EDGES}, {_BOTH} SELECT id, neighbour, relation FROM (SELECT 'S' || s_suppkey AS id, dst AS neighbour, relation, row_number() OVER (PARTITION BY s_suppkey ORDER BY edge_seq, dst) AS r FROM supplier JOIN both_ways ON src = 'S' || s_suppkey) WHERE r <= 50")
def neighbours_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to fifty neighbours of each supplier, either direction."""
    s = table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("id"), F.lit(0).alias("query_id"))
    w = Window.partitionBy("id").orderBy("edge_seq", "neighbour")
    return G.neighbours(s, edges(spark, sf_dir), line_tasks(spark, sf_dir)).withColumn("r", F.row_number().over(w)).where("r <= 50").select("id", "neighbour", "relation")


_HIT = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), hit AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS vid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, v.v), 9) DESC, v.vec_id) AS rank FROM v, v AS q WHERE q.vec_id % 50 = 0) WHERE rank <= 5)"
_LOW = "low AS (SELECT query_id, string_agg(t, chr(10) ORDER BY rank, r) AS context FROM (SELECT query_id, rank, 0 AS r, 'Entity: P' || vid AS t FROM hit UNION ALL SELECT query_id, rank, r, '  - related to ' || dst || ' via ' || relation FROM hit JOIN (SELECT src, dst, relation, row_number() OVER (PARTITION BY src ORDER BY edge_seq, dst) AS r FROM both_ways) AS b ON b.src = 'P' || vid WHERE r <= 5) GROUP BY query_id)"
_HIGH = "high AS (SELECT query_id, string_agg('Relationship: ' || src || ' -> ' || dst, chr(10) ORDER BY rank, src, dst) AS context FROM hit JOIN (SELECT 'P' || l_partkey AS src, 'S' || min(l_suppkey) AS dst, l_partkey FROM lineitem GROUP BY l_partkey) ON l_partkey = vid GROUP BY query_id)"


def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    # kept: a context reads its hits several times
    return settle(R.dense_topk(e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 5))


def low_context(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    hits = found.select("query_id", "rank", key("P", "id").alias("id"))
    w = Window.partitionBy("query_id", "id").orderBy("edge_seq", "neighbour")
    near = G.neighbours(hits, edges(spark, sf_dir)).withColumn("r", F.row_number().over(w)).where("r <= 5").join(hits, ["query_id", "id"])
    lines_ = hits.select("query_id", "rank", F.lit(0).alias("r"), F.concat(F.lit("Entity: "), "id").alias("t")).unionByName(near.select("query_id", "rank", "r", F.concat(F.lit("  - related to "), "neighbour", F.lit(" via "), "relation").alias("t")))
    return lines_.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "r", "t"))), lambda x: x["t"]), "\n").alias("context"))


def high_context(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    rel = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("s"))
    hits = found.join(rel, "id").select("query_id", "rank", F.concat(F.lit("Relationship: P"), "id", F.lit(" -> S"), "s").alias("t"))
    return R.context(hits, "t", "\n")


@query(f"WITH {_EDGES}, {_BOTH}, {_HIT}, {_LOW} SELECT query_id, context FROM low")
def low_level_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by vector with five edges each."""
    return low_context(spark, sf_dir, vector_hits(spark, sf_dir))


@query(f"WITH {_HIT}, {_HIGH} SELECT query_id, context FROM high")
def high_level_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by vector."""
    return high_context(spark, sf_dir, vector_hits(spark, sf_dir))


@query(f"""WITH {_EDGES}, {_BOTH}, {_HIT}, {_LOW}, {_HIGH}, chunk AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM hit JOIN documents ON doc_id = vid GROUP BY query_id)
SELECT query_id, '=== Original Text Context ===' || chr(10) || coalesce(chunk.context, '') || chr(10) || chr(10) || '=== Entity Context ===' || chr(10) || coalesce(low.context, '') || chr(10) || chr(10) || '=== Relationship Context ===' || chr(10) || coalesce(high.context, '') AS context FROM low LEFT JOIN chunk USING (query_id) LEFT JOIN high USING (query_id)""")
def dual_level_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, entities and relations of one question in sections."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = vector_hits(spark, sf_dir)
    chunk = R.context(found.join(docs, "id"), "text")
    return G.sections([("Original Text Context", chunk), ("Entity Context", low_context(spark, sf_dir, found)), ("Relationship Context", high_context(spark, sf_dir, found))])


_MAP = "mp AS (SELECT community_id, score, row_number() OVER (ORDER BY score DESC, CAST(community_id AS BIGINT)) AS place FROM (SELECT *, CASE WHEN contains(summary, 'the') THEN length(summary) % 101 ELSE 0 END AS score FROM (SELECT CAST(conv_id AS VARCHAR) AS community_id, text AS summary FROM conversations WHERE turn = 0 ORDER BY conv_id LIMIT 50)) WHERE score > 0)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("community_id"), F.col("text").alias("summary"))
    return G.global_answers(summaries, lambda s: F.when(F.contains(s, F.lit("the")), F.length(s) % 101).otherwise(0).cast("long"))


@query(f"WITH {_MAP} SELECT community_id, score, place FROM mp")
def global_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant community summaries, best first (default scorer)."""
    return answers(spark, sf_dir)


@query(f"""WITH {_MAP}, {_NODES}, {_EDGES}, {_TARGETS}, {_ENTRY}, {_NEAR}, lc AS (SELECT query_id, string_agg(DISTINCT id || ' -[' || relation || ']-> ' || neighbour, chr(10) ORDER BY id || ' -[' || relation || ']-> ' || neighbour) AS c FROM nr GROUP BY query_id),
lo AS (SELECT query_id, CASE WHEN length(c) > 16000 THEN substring(c, 1, 16000) || '...(truncated)' ELSE c END AS c FROM lc), gl AS (SELECT string_agg(community_id, ',' ORDER BY place) AS c FROM mp), qs AS (SELECT DISTINCT query_id FROM tg)
SELECT query_id, 'local' AS mode, coalesce(c, 'No relevant graph context found.') AS context FROM qs LEFT JOIN lo USING (query_id) UNION ALL SELECT query_id, 'global', coalesce(c, 'No relevant graph context found.') FROM qs, gl
UNION ALL SELECT query_id, 'hybrid', coalesce(lo.c, 'No relevant graph context found.') || chr(10) || coalesce(gl.c, 'No relevant graph context found.') FROM qs LEFT JOIN lo USING (query_id), gl""")
def mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the three modes, with a sentence where there is none."""
    q = targets(spark, sf_dir).select("query_id").distinct()
    local = q.join(one_hop_lines(spark, sf_dir), "query_id", "left").withColumn("context", G.or_else(F.col("context")))
    joined = answers(spark, sf_dir).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "community_id"))), lambda x: x["community_id"]), ",").alias("whole"))
    world = q.join(F.broadcast(joined), how="cross").select("query_id", G.or_else(F.col("whole")).alias("whole"))  # one row
    both = local.join(world, "query_id")
    return both.select("query_id", F.explode(F.array(F.struct(F.lit("local").alias("mode"), F.col("context").alias("c")), F.struct(F.lit("global").alias("mode"), F.col("whole").alias("c")), F.struct(F.lit("hybrid").alias("mode"), F.concat_ws("\n", "context", "whole").alias("c")))).alias("x")).select("query_id", "x.mode", F.col("x.c").alias("context"))
