"""Contexts from graphs: entry points, neighbourhoods, communities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedgewood.functions.text import truncate
from sedgewood.operators.graph_analytics import both_ways
from sedgewood.operators.state import deal


def folded(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def grams(c: str, sizes: str) -> Column:
    """The distinct substrings of a column that have the sizes of an array."""
    return F.expr(f"array_distinct(flatten(transform({sizes}, s -> if(length({c}) < s, cast(array() as array<string>), transform(sequence(1, length({c}) - s + 1), i -> substring({c}, i, s))))))")


def containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """n, t: the pairs of distinct names(n) and parts(t), not empty, where the name contains the part.

    A name that contains a part has each of its three-letter pieces (a shorter part is its own piece), so pairs meet in
    a join on the part's piece that the fewest names have, and are verified.  Either table may be large, and what Spark
    expects of the pieces' size is far below it: only distinct pieces may be broadcast, which an alphabet bounds.
    """
    own = parts.select("t").where("t <> ''").distinct().select("t", F.explode(grams("t", "array(least(3, length(t)))")).alias("gram"))
    pieces = names.select("n").distinct().select("n", F.explode(grams("n", "array(1, 2, 3)")).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    often = pieces.groupBy("gram").agg(F.count("*").alias("often"))
    # no inner join, which could broadcast the parts' pieces; a piece that no name has is the rarest
    rarest = own.join(often, "gram", "left").groupBy("t").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("gram"))
    return rarest.hint("merge").join(pieces, "gram").where(F.contains("n", "t")).select("n", "t")


def entry_points(targets: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """query_id, id, rank: nodes named like a target; for targets without one, all nodes that contain it, by id.

    Names are compared in lower case without spaces.
    """
    t = targets.select("query_id", folded(F.col("target")).alias("t")).where("t <> ''").distinct()
    n = nodes.select("id", folded(F.col("id")).alias("n")).hint("merge")  # names take many times the space of their file
    exact = t.join(n, t["t"] == n["n"]).select("query_id", "t", "id")
    rest = t.join(exact.select("query_id", "t").distinct(), ["query_id", "t"], "left_anti")
    near = rest.join(containing(n, rest), "t").join(n, "n").select("query_id", "t", "id")
    found = exact.unionByName(near).select("query_id", "id").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).cast("long")).where(F.col("rank") <= most)


def first_match(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, target, id: the node of that name, else the first by ordinal that contains it or that it contains."""
    t, n = targets.select("query_id", "target", F.lower("target").alias("t")).distinct(), nodes.select("id", "ordinal", F.lower("id").alias("n"))
    exact = t.join(nodes.select("id").hint("merge"), t["target"] == F.col("id")).select("query_id", "target", "id")
    rest = t.join(exact, ["query_id", "target"], "left_anti")
    either = containing(n, rest).unionByName(containing(rest.select(F.col("t").alias("n")), n.select(F.col("n").alias("t"))).select(F.col("t").alias("n"), F.col("n").alias("t"))).distinct()
    met = rest.join(either, "t").join(n.hint("merge"), "n").select("query_id", "target", "ordinal", "id")
    # an empty name is in every other: one row of nodes each
    least = F.min_by(F.struct("ordinal", "id"), F.struct("ordinal", "id")).alias("least")
    blank = rest.crossJoin(F.broadcast(n.where("n = ''").agg(least))).unionByName(rest.where("t = ''").crossJoin(F.broadcast(n.agg(least))))
    every = met.unionByName(blank.where("least is not null").select("query_id", "target", "least.ordinal", "least.id"))
    return exact.unionByName(every.groupBy("query_id", "target").agg(F.min_by("id", F.struct("ordinal", "id")).alias("id")))


def neighbours(entries: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """query_id, id, neighbour, relation, description, edge_seq for each edge of each entry, either way.

    For many entries, edges are dealt by their ends to ``parts`` tasks, where each entry's edges are then together.
    """
    turned = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "description", "edge_seq")
    both = edges.select("src", "dst", "relation", "description", "edge_seq").unionByName(turned)
    both = deal(both, parts, "src") if parts else both
    return entries.select("query_id", "id").join(both, F.col("id") == F.col("src")).select("query_id", "id", F.col("dst").alias("neighbour"), "relation", "description", "edge_seq")


def capped_context(entries: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """query_id, id, context: a line for the node, how many connections are left out, then the first ``most`` by edge_seq."""
    # counted by partial sums; only the first edges of a hub are ranked
    every = neighbours(entries, edges)
    counts = every.groupBy("query_id", "id").agg(F.count("*").alias("n"))
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("edge_seq", "neighbour"))).where(F.col("r") <= most)
    line = F.concat(F.lit("  - ["), "relation", F.lit("] -> "), "neighbour", F.when(F.col("description") != "", F.concat(F.lit("\n    (Details: "), "description", F.lit(")"))).otherwise(""))
    lines = first.groupBy("query_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    full = entries.select("query_id", "id").join(nodes.select("id", "type", "description"), "id").join(lines.join(counts, ["query_id", "id"]), ["query_id", "id"], "left")
    head = F.concat(F.lit("ENTITY: "), "id", F.lit(" ("), "type", F.lit(") - "), "description")
    cut = F.when(F.col("n") > most, F.concat(F.lit("    (Truncated "), (F.col("n") - most).cast("string"), F.lit(" other connections...)")))
    return full.select("query_id", "id", F.concat_ws("\n", head, cut, F.col("lines")).alias("context"))


def line_context(entries: DataFrame, edges: DataFrame, tokens: int = 4000) -> DataFrame:
    """query_id, context: the distinct edge lines of all entries, sorted, cut at four characters a token."""
    line = F.concat("id", F.lit(" -["), "relation", F.lit("]-> "), "neighbour")
    lines = neighbours(entries, edges).select("query_id", line.alias("line")).distinct()
    joined = lines.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("context"))
    return joined.withColumn("context", truncate(F.col("context"), tokens))


def global_answers(summaries: DataFrame, score: Callable[[Column], Column], most: int = 50, order_by: str = "id") -> DataFrame:
    """community_id, score, place of the first ``most`` summaries (by number of the id) that a scorer finds relevant, best first."""
    number = F.col("community_id").cast("long")
    chosen = summaries.orderBy(number if order_by == "id" else F.desc(order_by), number).limit(most)
    scored = chosen.withColumn("score", score(F.col("summary"))).where("score > 0")
    return scored.select("community_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), number)).cast("long").alias("place"))


def sections(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """query_id, context: the sections(query_id, context) with their titles, in order, blank where one has nothing."""
    out = None
    for i, (_, df) in enumerate(parts):
        own = df.select("query_id", F.col("context").alias(f"section_{i}"))
        out = own if out is None else out.join(own, "query_id", "full")
    text = F.concat_ws("\n\n", *(F.concat(F.lit(f"=== {title} ===\n"), F.coalesce(f"section_{i}", F.lit(""))) for i, (title, _) in enumerate(parts)))
    return out.select("query_id", text.alias("context"))


def or_else(context: Column, sentinel: str = "No relevant graph context found.") -> Column:
    return F.coalesce(F.nullif(context, F.lit("")), F.lit(sentinel))


__all__ = ["both_ways", "capped_context", "containing", "entry_points", "first_match", "folded", "global_answers", "line_context", "neighbours", "or_else", "sections"]
