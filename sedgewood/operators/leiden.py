"""Community detection by the Leiden method (Traag et al. 2019) with simultaneous moves.

A state holds id, community, k (strength) and size (how many nodes of the first graph it stands for) of each node.  Each
level moves nodes between communities, refines each community from single nodes, and goes on with the graph of the
refined parts, whose first communities are the unrefined ones.  All steps are joins and aggregates; a round in which too
many nodes moved at once, so that the quality fell, is taken back and tried with fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedgewood.operators.graph_analytics import coarsen, components
from sedgewood.operators.state import stored


def sides(edges: DataFrame) -> DataFrame:
    """Both directions of edges(src, dst, weight) without loops."""
    own = edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    return own.union(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def singles(edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The state in which each node of edges is alone; sizes(id, size) are 1 unless given.  A loop counts at both its ends."""
    ends = sides(edges).select(F.col("src").alias("id"), "weight").union(edges.where("src = dst").select(F.col("src").alias("id"), 2.0 * F.col("weight")))
    found = ends.groupBy("id").agg(F.sum("weight").alias("k"))
    found = found.withColumn("size", F.lit(1).cast("long")) if sizes is None else sizes.join(found, "id", "left").fillna(0.0, ["k"])
    return found.select("id", F.col("id").alias("community"), "k", "size")


def _expected(state: DataFrame, resolution: float, kind: str) -> float:
    """What ``kind`` expects of the weight inside the communities."""
    sums = state.groupBy("community").agg(F.sum("k").alias("k"), F.sum("size").cast("double").alias("n"), F.sum(F.col("size").cast("double") * F.col("size")).alias("own"))
    row = sums.agg(F.sum(F.col("k") * F.col("k")).alias("squares"), F.sum("k").alias("k"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
    if kind == "modularity":
        return resolution * (row["squares"] or 0.0) / (2 * (row["k"] or 1.0))
    return resolution * (row["pairs"] or 0.0)


def joined(edges: DataFrame, *states: DataFrame) -> DataFrame:
    """edges(src, dst, weight) with the communities a0, b0, a1, b1, ... that the states have for their two ends."""
    both = states[0].select("id", F.col("community").alias("c0"))
    for i, state in enumerate(states[1:], 1):
        both = both.join(state.select("id", F.col("community").alias(f"c{i}")), "id")
    for end, name in (("src", "a"), ("dst", "b")):
        edges = edges.join(both.select(F.col("id").alias(end), *(F.col(f"c{i}").alias(f"{name}{i}") for i in range(len(states)))), end)
    return edges


def qualities(edges: DataFrame, states: list[DataFrame], resolution: float = 1.0, kind: str = "modularity") -> list[float]:
    """Of states of the same nodes, by ``joined`` edges: weight inside communities less what ``kind`` expects of them."""
    inner = edges.agg(*(F.coalesce(F.sum(F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col("weight").cast("double"))), F.lit(0.0)) for i in range(len(states)))).first()
    return [x - _expected(state, resolution, kind) for x, state in zip(inner, states, strict=True)]


def quality(edges: DataFrame, state: DataFrame, resolution: float = 1.0, kind: str = "modularity") -> float:
    """Weight inside communities less what ``kind`` expects of them: modularity (times half the total) or cpm."""
    return qualities(joined(edges, state), [state], resolution, kind)[0]


def _mass(kind: str, total: float) -> tuple[Column, float]:
    """What a node weighs against a community's weight, and by what their product is divided."""
    return (F.col("k"), total) if kind == "modularity" else (F.col("size").cast("double"), 1.0)


def _admitted(moves: DataFrame, sums: DataFrame, most: int) -> DataFrame:
    """The moves(id, home, target, gain, size) that fit: each target takes those of largest gain up to ``most``.

    Nodes that are sure to leave make room for further ones in the same round.
    """
    w = Window.partitionBy("target").orderBy(F.desc("gain"), "id")

    def fitting(wanted: DataFrame, filled: DataFrame) -> DataFrame:
        first = wanted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)  # no more than that can fit
        return first.withColumn("sum", F.sum("size").over(w)).join(filled.select(F.col("community").alias("target"), "n"), "target").where(F.col("n") + F.col("sum") <= most).select(*moves.columns)

    one = stored(fitting(moves, sums))
    change = one.select(F.col("home").alias("community"), (-F.col("size")).alias("d")).union(one.select(F.col("target"), F.col("size"))).groupBy("community").agg(F.sum("d").alias("d"))
    filled = sums.join(change, "community", "left").select("community", (F.col("n") + F.coalesce("d", F.lit(0))).alias("n"))
    return one.unionByName(fitting(moves.join(one.select("id"), "id", "left_anti"), filled))


def local_moving(edges: DataFrame, state: DataFrame, resolution: float = 1.0, kind: str = "modularity", max_size: int | None = None, rounds: int = 5) -> DataFrame:
    """The state after rounds in which a share of the nodes (by hash) moves to the neighbouring community of largest gain.

    The quality never falls from round to round, and no community grows beyond ``max_size``.
    """
    both, state = stored(sides(edges)), stored(state)
    total = state.agg(F.sum("k")).first()[0] or 1.0
    mass, by = _mass(kind, total)
    expected, share, still = _expected(state, resolution, kind), 2, 0
    for r in range(rounds):
        sums = state.groupBy("community").agg(F.sum(mass).alias("mass"), F.sum("size").alias("n"))

        def turn(c: str, r: int = r, share: int = share) -> Column:
            """Every node has its turn once in ``share`` rounds, each time beside others."""
            return F.pmod(F.xxhash64(c, F.lit(r // share)), F.lit(share)) == r % share

        # a node carries its community's mass, so that links meet only the nodes at either end: they are dealt once by each
        known = state.select("id", "community", mass.alias("m"), "size").join(sums.select("community", "mass"), "community")
        own = known.where(turn("id")).select("id", F.col("community").alias("home"), "m", "size", F.col("mass").alias("home_mass"))
        # links to nodes that stay where they are this round; whose turn it is shows on the links before they are joined
        met = both.where(turn("src") & ~turn("dst")).join(known.where(~turn("id")).select(F.col("id").alias("dst"), "community", "mass"), "dst")
        to = met.select(F.col("src").alias("id"), "community", "mass", "weight").repartition("id").groupBy("id", "community").agg(F.sum("weight").alias("links"), F.first("mass").alias("mass"))
        ways = to.join(own, "id")
        at_home = F.col("community") == F.col("home")
        gain = F.round(F.col("links") - resolution * F.col("m") * F.col("mass") / by, 9)
        stay = F.round(F.when(at_home, F.col("links")).otherwise(0.0) - resolution * F.col("m") * (F.col("home_mass") - F.col("m")) / by, 9)
        away = F.when(~at_home, F.struct(gain.alias("gain"), F.col("community").alias("target"), "links"))
        best = ways.groupBy("id").agg(F.first("home").alias("home"), F.first("size").alias("size"), F.max(away).alias("b"), F.max(stay).alias("stay"), F.coalesce(F.max(F.when(at_home, F.col("links"))), F.lit(0.0)).alias("left"))
        moves = best.where("b.gain > stay").select("id", "home", "b.target", "b.gain", "size", (F.col("b.links") - F.col("left")).alias("more"))
        moves = stored(_admitted(stored(moves), sums, max_size) if max_size else moves)
        n, more = moves.agg(F.count("*"), F.sum("more")).first()
        if not n:
            still += 1
            if still > share:
                break
            continue
        changed = state.join(moves.select("id", "target"), "id", "left").select("id", F.coalesce("target", "community").alias("community"), "k", "size", F.col("community").alias("old"))
        changed = stored(changed)
        moved = changed.drop("old")
        # the moves' own sum knows no links between two nodes that both had their turn
        a, b = (changed.where(turn("id")).select(F.col("id").alias(x), F.col("community").alias(f"c_{x}"), F.col("old").alias(f"old_{x}")) for x in ("src", "dst"))
        met = both.where(turn("src") & turn("dst") & (F.col("src") < F.col("dst"))).join(a, "src").join(b, "dst")
        between = met.agg(F.sum(F.col("weight") * ((F.col("c_src") == F.col("c_dst")).cast("double") - (F.col("old_src") == F.col("old_dst")).cast("double")))).first()[0] or 0.0
        now = _expected(moved, resolution, kind)
        if more + between > now - expected:
            state, expected, still = moved, now, 0
        else:
            share *= 2
    return state


def refine(edges: DataFrame, state: DataFrame, resolution: float = 1.0, kind: str = "modularity", rounds: int = 3) -> DataFrame:
    """id, community, k, size and ``part``: communities taken apart into well-connected sets, from single nodes up.

    Only nodes that are still alone join another part of their community, and only where both are well connected to the
    rest of it and the join gains.  A part that nodes join this round loses none, so every part is connected.
    """
    groups = state.select(F.col("id").alias("src"), F.col("community").alias("c1")), state.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    inner = sides(stored(edges.where("src <> dst").join(groups[0], "src").join(groups[1], "dst").where("c1 = c2").select("src", "dst", "weight")))
    total = state.agg(F.sum("k")).first()[0] or 1.0
    mass, by = _mass(kind, total)
    whole = stored(state.groupBy("community").agg(F.sum(mass).alias("whole")))
    parts = stored(state.select("id", "community", "k", "size", F.col("id").alias("part"), mass.alias("mass")))
    graph = inner.select(F.col("src").alias("p1"), F.col("dst").alias("p2"), F.col("weight").alias("links"))  # between parts
    for r in range(rounds):
        out = graph.groupBy(F.col("p1").alias("part")).agg(F.sum("links").alias("out"))
        sums = parts.groupBy("part", "community").agg(F.sum("mass").alias("mass"), F.count("*").alias("members"))
        turn = (F.col("members") == 1) & (F.pmod(F.xxhash64("part", F.lit(r)), F.lit(2)) == 0)
        sound = sums.join(out, "part").join(whole, "community").where(F.col("out") >= resolution * F.col("mass") * (F.col("whole") - F.col("mass")) / by)
        sound = stored(sound.select("part", "mass", turn.alias("moves")))
        movers, targets = sound.where("moves").select(F.col("part").alias("p1"), F.col("mass").alias("m")), sound.where("not moves").select(F.col("part").alias("p2"), "mass")
        gain = F.round(F.col("links") - resolution * F.col("m") * F.col("mass") / by, 9).alias("gain")
        joins = graph.join(movers, "p1").join(targets, "p2").select("p1", F.struct(gain, "p2").alias("way")).where("way.gain > 0").groupBy(F.col("p1").alias("part")).agg(F.max("way").alias("way"))
        joins = stored(joins.select("part", F.col("way.p2").alias("target")))
        if joins.isEmpty() and r:
            break
        parts = stored(parts.join(joins, "part", "left").select("id", "community", "k", "size", F.coalesce("target", "part").alias("part"), "mass"))
        if r == rounds - 1:
            break
        ends = graph
        for side in ("p1", "p2"):
            ends = ends.join(joins.select(F.col("part").alias(side), "target"), side, "left").withColumn(side, F.coalesce("target", side)).drop("target")
        graph = stored(ends.where("p1 <> p2").groupBy("p1", "p2").agg(F.sum("links").alias("links")))
    return parts.drop("mass")


def connected(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Communities split into their connected parts, each named after its smallest member."""
    a, b = found.select(F.col("id").alias("src"), F.col("community").alias("c1")), found.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    return components(found.select("id"), edges.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst")).select("id", F.col("component").alias("community"))


def leiden(edges: DataFrame, resolution: float = 1.0, kind: str = "modularity", max_size: int | None = None, levels: int = 2, rounds: int = 5) -> DataFrame:
    """id, community (its smallest member) of each node of weighted edges(src, dst, weight); communities are connected."""
    graph, state = edges.select("src", "dst", "weight"), singles(edges)
    members = None
    for level in range(levels):
        state = local_moving(graph, state, resolution, kind, max_size, rounds)
        members = state.select("id", F.col("id").alias("node")) if members is None else members
        if level == levels - 1:
            break
        parts = refine(graph, state, resolution, kind)
        count = parts.agg(F.count("*"), F.count_distinct("part")).first()
        if count[0] == count[1]:
            break
        members = stored(members.join(parts.select(F.col("id").alias("node"), "part"), "node").select("id", F.col("part").alias("node")))
        graph = stored(coarsen(graph, parts.select("id", F.col("part").alias("community")), loops=True))
        state = parts.groupBy(F.col("part").alias("id")).agg(F.min("community").alias("community"), F.sum("k").alias("k"), F.sum("size").alias("size"))
    found = members.join(state.select(F.col("id").alias("node"), "community"), "node").select("id", "community")
    return stored(connected(edges, stored(found)))


def capped_hierarchy(edges: DataFrame, resolutions: list[float], sizes: list[int | None], rounds: int = 4, filled: float = 0.9) -> DataFrame:
    """id, level, community from the finest level (the largest number) to the coarsest, by the constant Potts model.

    No community of a level has more nodes of that level than its size allows.  Communities that fill ``filled`` of it
    are the nodes of the next level; the others end there.
    """
    current, members, out = edges.select("src", "dst", "weight"), None, None
    for step, (gamma, most) in enumerate(zip(resolutions, sizes, strict=True)):
        level = len(resolutions) - 1 - step
        state = local_moving(current, singles(current), gamma, "cpm", most, rounds)
        named = stored(connected(current, state.select("id", "community")).select(F.col("id").alias("node"), F.concat(F.lit(f"L{level}_"), "community").alias("community")))
        members = stored(named.withColumnRenamed("node", "id") if members is None else members.join(named, "node").select("id", "community"))
        part = members.select("id", F.lit(level).cast("long").alias("level"), "community")
        out = part if out is None else out.unionByName(part)
        count = named.groupBy("community").count()
        full = stored(count if most is None else count.where(F.col("count") >= int(most * filled)))
        if level == 0 or full.count() < 2:
            break
        chosen = named.join(full, "community", "left_semi").select(F.col("node").alias("id"), "community")
        current = stored(coarsen(current, chosen))
        members = members.join(full, "community", "left_semi").select("id", F.col("community").alias("node"))
        if current.isEmpty():
            break
    return out
