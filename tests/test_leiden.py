from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from sedgewood.operators import leiden as L


def planted(seed: int = 1, groups: int = 8, size: int = 12, inside: float = 0.6, across: float = 0.02):
    rng = random.Random(seed)
    n = groups * size
    return [(f"v{a:03d}", f"v{b:03d}") for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else across)]


def greedy(edges: list[tuple[str, str]]) -> float:
    """Modularity of a plain sequential local moving from single nodes, on one machine."""
    near, m = defaultdict(set), len(edges)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    where = {v: v for v in near}
    sums = Counter({v: len(near[v]) for v in near})
    for _ in range(10):
        for v in sorted(near):
            sums[where[v]] -= len(near[v])
            links = Counter(where[u] for u in near[v])
            links.setdefault(where[v], 0)
            where[v] = max(links, key=lambda c: (links[c] - len(near[v]) * sums[c] / (2 * m), c))
            sums[where[v]] += len(near[v])
    return modularity(edges, where)


def modularity(edges, where) -> float:
    m, inner, sums = len(edges), 0, Counter()
    for a, b in edges:
        inner += where[a] == where[b]
        sums[where[a]] += 1
        sums[where[b]] += 1
    return inner / m - sum(x * x for x in sums.values()) / (4 * m * m)


def pieces(edges, where) -> int:
    """Communities that are not connected."""
    root = {v: v for v in where}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if where[a] == where[b]:
            root[find(a)] = find(b)
    return len({(where[v], find(v)) for v in where}) - len(set(where.values()))


def frame(spark, edges):
    return spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")


def test_leiden_on_a_planted_graph(spark):
    edges = planted(1, 6, 10, 0.7, 0.03)
    found = {r["id"]: r["community"] for r in L.leiden(frame(spark, edges), rounds=8).collect()}
    assert pieces(edges, found) == 0
    assert modularity(edges, found) >= greedy(edges) - 0.05


def test_refined_parts_are_connected_and_stay_within(spark):
    edges = planted(2)
    df = frame(spark, edges)
    # one community too many: everything together, and pairs of groups
    state = L.stored(L.singles(df).selectExpr("id", "concat('c', floor(cast(substr(id, 2) as int) / 24)) as community", "k", "size"))
    rows = L.refine(df, state).collect()
    inside = {}
    for r in rows:
        assert inside.setdefault(r["part"], r["community"]) == r["community"]
    assert pieces(edges, {r["id"]: r["part"] for r in rows}) == 0
    assert 4 < len(inside) < len(rows)


@pytest.mark.parametrize("kind", ["modularity", "cpm"])
def test_quality_never_falls(spark, kind):
    df = frame(spark, planted(3, 4, 10))
    gamma, state, last = (1.0, None, None) if kind == "modularity" else (0.2, None, None)
    for rounds in (1, 2):
        state = L.local_moving(df, L.singles(df), gamma, kind, None, rounds)
        now = L.quality(df, state, gamma, kind)
        assert last is None or now >= last
        last = now


def test_capacity_holds_and_leavers_make_room(spark):
    df = frame(spark, planted(4, 3, 14, 0.9, 0.1))
    state = L.local_moving(df, L.singles(df), 0.1, "cpm", 3, 3).collect()
    assert max(Counter(r["community"] for r in state).values()) == 3
    moves = spark.createDataFrame([("a", "x", "y", 3.0, 1), ("b", "y", "x", 2.0, 1), ("c", "z", "y", 1.0, 1)], "id string, home string, target string, gain double, size long")
    sums = spark.createDataFrame([("x", 1.0, 1), ("y", 1.0, 2), ("z", 1.0, 1)], "community string, mass double, n long")
    # y is full until b has left it
    assert sorted(r["id"] for r in L._admitted(moves, sums, 2).collect()) == ["a", "b"]


def test_hierarchy_under_limits(spark):
    edges = planted(5, 6, 10, 0.9, 0.05)
    rows = L.capped_hierarchy(frame(spark, edges), [0.2, 0.2, 0.1], [5, 4, None], 3).collect()
    finest = Counter(r["community"] for r in rows if r["level"] == 2)
    assert max(finest.values()) <= 5 and sum(finest.values()) == 60
    parents = defaultdict(set)
    fine = {r["id"]: r["community"] for r in rows if r["level"] == 2}
    for r in rows:
        if r["level"] == 1:
            parents[r["community"]].add(fine[r["id"]])
            assert finest[fine[r["id"]]] >= 4  # only communities that fill nine tenths go on
    assert all(len(x) <= 4 for x in parents.values())
