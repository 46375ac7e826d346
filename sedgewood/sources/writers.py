"""Sinks for indexes, requests, graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sedgewood.operators.jobs import upsert


def build_once(df: DataFrame, path: str) -> None:
    """Write an index unless it is there."""
    df.write.mode("ignore").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Overwrite one table and nothing beside it."""
    df.write.mode("overwrite").parquet(path)


def upsert_table(new: DataFrame, path: str, target: str, key: str, version: str) -> None:
    """The table at ``path`` with new rows by key, written to ``target``; the old one stays as it was."""
    upsert(new.sparkSession.read.parquet(path), new, key, version).write.mode("overwrite").parquet(target)


def write_jsonl_parts(df: DataFrame, path: str, part: str, line: str) -> None:
    """A folder for each part with one JSON text a line."""
    df.select(part, F.col(line).alias("value")).write.mode("overwrite").partitionBy(part).text(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as csv, json or Markdown lines in one file."""
    if kind == "markdown":
        head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)], "value string")
        body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |")).alias("value"))
        head.union(body).coalesce(1).write.mode("overwrite").text(path)
    elif kind == "json":
        df.coalesce(1).write.mode("overwrite").json(path)
    else:
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def graph_fragments(nodes: DataFrame, edges: DataFrame, kind: str = "gexf") -> DataFrame:
    """section, value: the lines of a GEXF or GraphML file's nodes(id, label) and edges(src, dst), without the envelope."""

    def quoted(c: str):
        out = F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    label = F.concat(F.lit('" label="'), quoted("label")) if kind == "gexf" else F.lit("")
    n = nodes.select(F.lit("nodes").alias("section"), F.concat(F.lit('<node id="'), quoted("id"), label, F.lit('"/>')).alias("value"))
    e = edges.select(F.lit("edges").alias("section"), F.concat(F.lit('<edge source="'), quoted("src"), F.lit('" target="'), quoted("dst"), F.lit('"/>')).alias("value"))
    return n.unionByName(e)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "gexf") -> None:
    """A whole GEXF or GraphML file of nodes(id, label) and edges(src, dst), as one part in the folder ``path``."""
    lines = graph_fragments(nodes, edges, kind)
    gexf = kind == "gexf"
    head = ['<?xml version="1.0" encoding="UTF-8"?>', *(('<gexf xmlns="http://gexf.net/1.2draft" version="1.2">', '<graph defaultedgetype="directed">', "<nodes>") if gexf else ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">'))]
    middle, tail = (["</nodes>", "<edges>"], ["</edges>", "</graph>", "</gexf>"]) if gexf else ([], ["</graph>", "</graphml>"])

    fixed = nodes.sparkSession.createDataFrame([(i, "\n".join(t)) for i, t in ((0, head), (2, middle), (4, tail)) if t], "place int, value string")
    body = lines.select(F.when(F.col("section") == "nodes", 1).otherwise(3).alias("place"), "value")
    fixed.unionByName(body).coalesce(1).sortWithinPartitions("place", "value").select("value").write.mode("overwrite").text(path)


def drop_communities(df: DataFrame) -> DataFrame:
    """df without every column that names a community."""
    return df.drop(*(c for c in df.columns if "community" in c))
