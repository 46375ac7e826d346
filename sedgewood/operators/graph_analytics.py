"""Analytics of undirected simple graphs: nodes(id) and edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sedgewood.operators.state import deal, settle


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and degree of each node; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reached) of each node, by alternating large-star and small-star rounds.

    Rounds grow with the logarithm of the graph; each is checkpointed.  No component is gathered anywhere.
    """

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # repeated links do no harm: each round has no more than it was given, and its result is distinct
    links, seen = settle(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b")), None
    while True:
        turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))  # the half in which b > a
        least = links.union(turned).groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = turned.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        links = settle(small.where("a <> b").distinct())
        now = digest(links)
        if now == seen or not now[0]:
            break
        seen = now
    return nodes.select("id").join(links.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def health(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: size, density, degrees, components, and how sound the graph is."""
    n, m = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    deg = degrees(nodes, edges).agg(F.count_if(F.col("degree") == 0).alias("isolates"), F.count_if(F.col("degree") == 1).alias("leaves"))
    comp = parts.groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("giant"))
    one = n.join(m, how="cross").join(deg, how="cross").join(comp, how="cross")  # four single rows
    return one.select(
        "n", "m", F.round(2.0 * F.col("m") / F.col("n"), 6).alias("avg_degree"), F.round(2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1.0)), 9).alias("density"), "isolates", "leaves", "components", "giant",
        F.round(100.0 * F.col("giant") / F.col("n"), 6).alias("giant_percent"),
        F.when(100.0 * F.col("giant") / F.col("n") < 10, "critical").when(100.0 * F.col("giant") / F.col("n") < 50, "warning").otherwise("good").alias("connectivity"),
        F.when(100.0 * F.col("isolates") / F.col("n") > 10, "warning").otherwise("good").alias("isolation"),
    )


def coarsen(edges: DataFrame, assignment: DataFrame, loops: bool = False) -> DataFrame:
    """src, dst, weight between different communities of edges(src, dst, weight) under assignment(id, community).

    With ``loops``, the weight inside a community is kept as its loop.
    """
    a, b = assignment.select(F.col("id").alias("src"), F.col("community").alias("c1")), assignment.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    joined = edges.join(a, "src").join(b, "dst")
    joined = joined if loops else joined.where("c1 <> c2")
    return joined.groupBy(F.least("c1", "c2").alias("src"), F.greatest("c1", "c2").alias("dst")).agg(F.sum("weight").alias("weight"))


def vote(removed: DataFrame, edges: DataFrame, assignment: DataFrame, parts: int | None = None) -> DataFrame:
    """id, level, community: for removed nodes, the commonest community of their neighbours on each level, ties to the smallest.

    Links are dealt to ``parts`` tasks by either end; a node's votes are counted, ranked and put together in one of them.
    """
    # no semi-join, which Spark would move below the dealing
    near = deal(both_ways(edges), parts, "src").join(deal(removed.select(F.col("id").alias("src")), parts, "src").distinct(), "src")
    votes = deal(deal(near, parts, "dst").join(assignment.withColumnRenamed("id", "dst"), "dst").select("src", "level", "community"), parts, "src")
    w = Window.partitionBy("src", "level").orderBy(F.desc("count"), "community")
    best = votes.where("level is not null").groupBy("src", "level", "community").count().withColumn("r", F.row_number().over(w)).where("r = 1")
    placed = best.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("level", "community"))).alias("placed"))
    levels = assignment.select("level").distinct()
    full = removed.select("id").join(placed, "id", "left").join(F.broadcast(levels), how="cross")  # a handful of levels
    return full.select("id", "level", F.coalesce(F.try_element_at("placed", F.col("level")), F.lit("L0_0")).alias("community"))


def fill_levels(df: DataFrame, levels: list[str]) -> DataFrame:
    """Each level, from fine to coarse, takes the nearest finer one where it is missing."""
    out = df
    for i, c in enumerate(levels):
        out = out.withColumn(c, F.coalesce(*levels[i::-1]))
    return out


def top_members(assignment: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """id, community, inner_degree of the ``most`` members of each community with the most edges inside it."""
    a, b = assignment.select(F.col("id").alias("src"), F.col("community").alias("c1")), assignment.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").where("c1 = c2")
    deg = inner.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("inner_degree"))
    full = assignment.join(deg, "id", "left").fillna(0, ["inner_degree"])
    w = Window.partitionBy("community").orderBy(F.desc("inner_degree"), "id")
    return full.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("id", "community", "inner_degree")


def local_moving(edges: DataFrame, resolution: float = 1.0, quality: str = "modularity", max_size: int | None = None, rounds: int = 5) -> DataFrame:
    """id, community of weighted edges(src, dst, weight): nodes move to the neighbouring community of largest gain.

    All nodes of one half (by a hash that changes each round) move at once, so two never swap places.  ``quality`` is
    modularity or cpm.  Where communities are limited in size, each takes the movers of largest gain that fit.
    """
    sides = settle(edges.where("src <> dst").select("src", "dst", "weight").union(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    # a loop counts at both its ends
    ends = sides.select(F.col("src").alias("id"), "weight").union(edges.where("src = dst").select("src", 2 * F.col("weight")))
    strength = settle(ends.groupBy("id").agg(F.sum("weight").alias("k")))
    total = strength.agg(F.sum("k")).first()[0] or 1.0
    state = settle(strength.select("id", F.col("id").alias("community"), "k"))
    for r in range(rounds):
        sums = state.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
        to = sides.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("links"))
        own = state.select("id", F.col("community").alias("home"), "k").where(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0)
        ways = to.join(own, "id").join(sums, "community")
        at_home = F.col("community") == F.col("home")
        if quality == "modularity":
            gain = F.col("links") - resolution * F.col("k") * (F.col("total") - F.when(at_home, F.col("k")).otherwise(0.0)) / total
        else:
            gain = F.col("links") - resolution * (F.col("n") - F.when(at_home, 1).otherwise(0))
        ways = ways.withColumn("gain", F.round(gain, 9))
        best = ways.groupBy("id", "home").agg(F.max_by(F.struct("community", "gain", "n"), F.struct("gain", "community")).alias("b"), F.max(F.when(at_home, F.col("gain"))).alias("stay"))
        moves = best.where((F.col("b.community") != F.col("home")) & (F.col("b.gain") > F.coalesce("stay", F.lit(0.0)))).select("id", F.col("b.community").alias("target"), F.col("b.gain").alias("gain"), F.col("b.n").alias("n"))
        if max_size:
            w = Window.partitionBy("target").orderBy(F.desc("gain"), "id")
            moves = moves.withColumn("place", F.row_number().over(w)).where(F.col("n") + F.col("place") <= max_size)
        moves = settle(moves.select("id", "target"))
        if moves.isEmpty():
            break
        state = settle(state.join(moves, "id", "left").select("id", F.coalesce("target", "community").alias("community"), "k"))
    return state.select("id", "community")


def refine(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities split into their connected parts, each named after its smallest member."""
    a, b = assignment.select(F.col("id").alias("src"), F.col("community").alias("c1")), assignment.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    inner = edges.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst")
    return components(assignment.select("id"), inner).select("id", F.col("component").alias("community"))


def communities(edges: DataFrame, resolution: float = 1.0, quality: str = "modularity", levels: int = 2, rounds: int = 5) -> DataFrame:
    """id, community: local moving and refinement, then the same on the graph of communities while that changes something."""
    weighted = edges.select("src", "dst", F.lit(1.0).alias("weight"))
    found = settle(refine(local_moving(weighted, resolution, quality, None, rounds), weighted))
    for _ in range(levels - 1):
        upper = settle(coarsen(weighted, found, loops=True))
        if upper.where("src <> dst").isEmpty():
            break
        moved = settle(refine(local_moving(upper, resolution, quality, None, rounds), upper).select(F.col("id").alias("community"), F.col("community").alias("parent")))
        found = settle(found.join(moved, "community", "left").select("id", F.coalesce("parent", "community").alias("community")))
    return found


def hierarchy(edges: DataFrame, resolutions: list[float], sizes: list[int | None], rounds: int = 3) -> DataFrame:
    """id, level, community from the finest level (the first) to the coarsest: communities that fill nine tenths of the
    size limit of their level are the nodes of the next one, the rest end there."""
    current, members, out = edges.select("src", "dst", F.lit(1.0).alias("weight")), None, None
    for step, (gamma, most) in enumerate(zip(resolutions, sizes, strict=True)):
        level = len(resolutions) - 1 - step
        found = settle(refine(local_moving(current, gamma, "cpm", most, rounds), current))
        named = found.select(F.col("id").alias("node"), F.concat(F.lit(f"L{level}_"), "community").alias("community"))
        members = named.withColumnRenamed("node", "id") if members is None else members.join(named, "node").select("id", "community")
        members = settle(members)
        part = members.select("id", F.lit(level).cast("long").alias("level"), "community")
        out = part if out is None else out.unionByName(part)
        count = named.groupBy("community").count()
        full = count if most is None else count.where(F.col("count") >= int(most * 0.9))
        if level == 0 or full.count() < 2:
            break
        chosen = named.join(full, "community", "left_semi").select(F.col("node").alias("id"), "community")
        current = settle(coarsen(current, chosen))
        members = members.join(full, "community", "left_semi").select("id", F.col("community").alias("node"))
        if current.isEmpty():
            break
    return out


def modularity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: the modularity of an assignment of unweighted edges."""
    a, b = assignment.select(F.col("id").alias("src"), F.col("community").alias("c1")), assignment.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    both = edges.select("src", "dst").join(a, "src").join(b, "dst")
    inner = both.agg(F.count_if(F.col("c1") == F.col("c2")).alias("inner"), F.count("*").alias("m"))
    deg = both.select(F.explode(F.array("c1", "c2")).alias("c")).groupBy("c").count().agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"))
    return inner.join(deg, how="cross").select(F.round(F.col("inner") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m")), 6).alias("modularity"))
