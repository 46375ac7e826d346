"""From extractions to node and edge tables.  Order-dependent rules follow an explicit ``seq`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sedgewood.functions.text import unfence

PAYLOAD = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,relation_type:string,description:string>>"
RESPONSE = (
    "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string,"
    "tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>>>"
)


def parse_responses(lines: DataFrame, value: str = "value", function: str = "GraphExtraction") -> DataFrame:
    """custom_id, call_no, payload: of JSON lines with status 200, the arguments of each call of the function, or else the
    message's content without its Markdown fence.  Lines that are no JSON are skipped."""
    parsed = lines.where(F.trim(value) != "").select(F.from_json(value, RESPONSE).alias("r")).where("r.response.status_code = 200")
    message = F.get(F.col("r.response.body.choices"), F.lit(0))["message"]
    rows = parsed.select("r.custom_id", message["content"].alias("content"), F.filter(F.coalesce(message["tool_calls"], F.expr("array()")), lambda c: c["function"]["name"] == function).alias("calls"))
    texts = F.when(F.size("calls") > 0, F.transform("calls", lambda c: c["function"]["arguments"])).otherwise(F.array(unfence(F.col("content"))))
    return rows.select("custom_id", F.posexplode(texts).alias("call_no", "text")).select("custom_id", "call_no", F.from_json("text", PAYLOAD).alias("payload")).where("payload is not null")


def corrupt_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that are not JSON."""
    return lines.where((F.trim(value) != "") & F.try_parse_json(value).isNull())


def entity_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("custom_id", "call_no", F.posexplode("payload.entities").alias("pos", "e")).select("custom_id", "call_no", "pos", "e.name", "e.type", "e.description")


def relation_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("custom_id", "call_no", F.posexplode("payload.relationships").alias("pos", "e")).select("custom_id", "call_no", "pos", "e.source", "e.target", "e.relation_type", "e.description")


def _known(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def upsert_nodes(entities: DataFrame, relations: DataFrame | None = None, wins: str = "first") -> DataFrame:
    """name, type, description of entities(seq, name, type, description): the first or the last by seq wins.

    With relations(seq, source, target), an endpoint that has no node yet when its relation comes is a node of unknown
    type from then on, which a later entity does not improve if the first wins.
    """
    every = entities.where(F.coalesce(F.trim("name"), F.lit("")) != "").select("seq", "name", _known("type", "UNKNOWN").alias("type"), _known("description", "").alias("description"))
    if relations is not None:
        ends = relations.select("seq", F.explode(F.array("source", "target")).alias("name")).where(F.coalesce(F.trim("name"), F.lit("")) != "")
        every = every.unionByName(ends.select("seq", "name", F.lit("UNKNOWN").alias("type"), F.lit("").alias("description")))
    pick = F.min_by if wins == "first" else F.max_by
    best = every.groupBy("name").agg(pick(F.struct("type", "description"), F.struct("seq", "type", "description")).alias("n"))
    return best.select("name", "n.type", "n.description")


def collapse_edges(relations: DataFrame) -> DataFrame:
    """src, dst, relation, description: one undirected edge a pair, the attributes of the last relation by seq."""
    ok = relations.where((F.coalesce(F.trim("source"), F.lit("")) != "") & (F.coalesce(F.trim("target"), F.lit("")) != ""))
    pairs = ok.select(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), "seq", _known("relation", "RELATED_TO").alias("relation"), _known("description", "").alias("description"))
    best = pairs.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "description"), F.struct("seq", "relation", "description")).alias("e"))
    return best.select("src", "dst", "e.relation", "e.description")


def provenance(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """keys.. and the sorted distinct sources of each, as a JSON array."""
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_set(source))).alias("source_chunk_ids"))


def concat_extractions(parsed: DataFrame, key: str) -> DataFrame:
    """The number of entities and relationships of all payloads of each key, put one after another."""
    return parsed.groupBy(key).agg(F.sum(F.size("payload.entities")).cast("long").alias("n_entities"), F.sum(F.size("payload.relationships")).cast("long").alias("n_relationships"))


def node_text(label: Column, kind: Column, description: Column) -> Column:
    return F.concat(label, F.lit(" ("), kind, F.lit("): "), description)


def edge_text(source: Column, relation: Column, target: Column, description: Column) -> Column:
    return F.concat(source, F.lit(" -["), relation, F.lit("]-> "), target, F.lit(": "), description)


def glean(known: DataFrame, rounds: list[DataFrame], keys: list[str]) -> DataFrame:
    """known with the rows of each further round that are new by their keys; stops at a round that brings nothing."""
    out = known
    for r in rounds:
        new = r.dropDuplicates(keys).join(out, keys, "left_anti")
        if new.isEmpty():
            break
        out = out.unionByName(new)
    return out


def normalise_entities(df: DataFrame, name: str, aliases: DataFrame, banned: list[str]) -> DataFrame:
    """Names through an alias table(alias, canonical), without blocked words and names that are dates or numbers."""
    named = df.join(aliases, df[name] == aliases["alias"], "left").withColumn(name, F.coalesce("canonical", name)).drop("alias", "canonical")
    return named.where(~F.lower(name).isin(banned) & ~F.col(name).rlike(r"^[\d.,%/: -]+$"))


def merge_property_nodes(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key with the properties of all its versions merged, later ones winning."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(version).alias("v"), F.col("props").alias("p"))), lambda a, b: F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))
    merged = F.aggregate(ordered, F.create_map().cast("map<string,string>"), lambda a, x: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(x["p"], k)), x["p"]))
    return df.groupBy(key).agg(merged.alias("props"))
