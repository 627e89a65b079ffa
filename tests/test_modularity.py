"""Communities by modularity: a small hierarchy, a random graph against one move after the other, edge cases."""

from __future__ import annotations

import random

import pytest

from tessera.operators import graph, modularity


def louvain(nodes: list, edges: list[tuple], resolution: float = 1.0) -> dict:
    """Communities of a small graph, one move after the other in sorted order."""
    belongs = {n: n for n in nodes}
    graph: dict = {n: {} for n in nodes}
    for u, v, w in edges:
        graph[u][v] = graph[u].get(v, 0.0) + w
        graph[v][u] = graph[v].get(u, 0.0) + w
    total = sum(sum(x.values()) for x in graph.values())
    while total > 0:
        degree = {n: sum(x.values()) for n, x in graph.items()}
        of = {n: n for n in graph}
        weight = dict(degree)
        moved = improved = True
        while moved:
            moved = False
            for n in sorted(graph):
                links: dict = {}
                for m, w in graph[n].items():
                    if m != n:
                        links[of[m]] = links.get(of[m], 0.0) + w
                weight[of[n]] -= degree[n]
                gain = lambda c: links.get(c, 0.0) - resolution * weight[c] * degree[n] / total  # noqa: B023, E731
                best = max(sorted({*links, of[n]}), key=lambda c: (gain(c), c == of[n]))
                if best != of[n] and gain(best) > gain(of[n]) + 1e-12:
                    of[n], moved = best, True
                weight[of[n]] += degree[n]
        if len(set(of.values())) == len(graph):
            improved = False
        belongs = {n: of[c] for n, c in belongs.items()}
        if not improved:
            break
        merged: dict = {c: {} for c in set(of.values())}
        for n, x in graph.items():
            for m, w in x.items():
                merged[of[n]][of[m]] = merged[of[n]].get(of[m], 0.0) + w
        graph = merged
    first: dict = {}
    for n in sorted(belongs):
        first.setdefault(belongs[n], n)
    return {n: first[c] for n, c in belongs.items()}


def value(edges, of):
    """Modularity by its definition."""
    total = 2 * sum(w for _, _, w in edges)
    k: dict = {}
    for u, v, w in edges:
        k[of[u]] = k.get(of[u], 0.0) + w
        k[of[v]] = k.get(of[v], 0.0) + w
    return 2 * sum(w for u, v, w in edges if of[u] == of[v]) / total - sum(x * x for x in k.values()) / total**2


def assert_hierarchy(rows, ids, edges):
    """Levels from 0, each over all ids, named by smallest members, connected, and merging the one before."""
    levels: dict = {}
    for r in rows:
        levels.setdefault(r.level, {})[r.id] = r.community
    assert sorted(levels) == list(range(len(levels))) and len(rows) == len(ids) * len(levels)
    for n, of in levels.items():
        assert set(of) == set(ids)
        members: dict = {}
        for i, c in of.items():
            members.setdefault(c, set()).add(i)
        for c, group in members.items():
            assert c == min(group)
            seen, todo = {c}, [c]
            while todo:
                at = todo.pop()
                for u, v, _ in edges:
                    for a, b in ((u, v), (v, u)):
                        if a == at and b in group and b not in seen:
                            seen.add(b)
                            todo.append(b)
            assert seen == group
        if n:
            assert all(of[a] == of[c] for a, c in levels[n - 1].items()) and of != levels[n - 1]
    return levels


def relations(spark, edges, kind):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}, weight double")


def test_levels_of_six_cliques(spark):
    """Six triangles in a ring of weak bridges: the triangles come first, then they merge."""
    names = "abcdefghijklmnopqr"
    edges = []
    for c in range(6):
        x, y, z = names[3 * c : 3 * c + 3]
        edges += [(x, y, 9.0 + c / 10), (y, z, 8.0 - c / 10), (x, z, 7.0 + c / 7), (z, names[(3 * c + 3) % 18], 1.0 - c / 10)]
    ids = spark.createDataFrame([(x,) for x in names] + [("lone",), (None,), ("a",)], "id string").selectExpr("id", "1 as k", "2 as weight")
    got = assert_hierarchy(graph.leiden_levels(ids, relations(spark, [*edges, ("a", "a", 5.0), ("a", "gone", 5.0), (None, "a", 1.0)], "string")).collect(), [*names, "lone"], edges)
    assert [len(set(got[n].values())) for n in (0, len(got) - 1)] == [7, 2] and len(got) >= 2
    assert {i: c for i, c in got[0].items() if i != "lone"} == {x: names[3 * (k // 3)] for k, x in enumerate(names)}


@pytest.fixture(scope="module")
def tangled():
    """Groups of twelve nodes with half of their pairs linked, and as many links across as a fifth of those; one hub."""
    rng = random.Random(5)
    found = {}
    for u in range(72):
        for v in range(u + 1, 72):
            if rng.random() < (0.5 if u // 12 == v // 12 else 0.02) or u == 0 and rng.random() < 0.3:
                found[u, v] = float(rng.randint(1, 3))
    return [(u, v, w) for (u, v), w in found.items()]


def test_leiden_is_no_worse_than_one_move_at_a_time(spark, tangled):
    plain = louvain(sorted({x for u, v, _ in tangled for x in (u, v)}), tangled)
    ids = spark.range(72)
    found = graph.leiden_levels(ids, relations(spark, tangled, "long"), (1.0,))
    of = assert_hierarchy(found.collect(), range(72), tangled)[0]
    assert value(tangled, of) >= value(tangled, plain) - 0.01
    mine = modularity.modularity(graph.consolidated_edges(relations(spark, tangled, "long")), found).first().modularity
    assert mine == pytest.approx(value(tangled, of))


def test_without_edges_or_entities(spark):
    two = spark.createDataFrame([("a",), ("b",)], "id string")
    none = relations(spark, [], "string")
    assert [tuple(r) for r in graph.leiden_levels(two, none).sort("id").collect()] == [(0, "a", "a"), (0, "b", "b")]
    assert graph.leiden_levels(two.limit(0), none).count() == graph.communities(two.limit(0), none).count() == 0
    assert modularity.modularity(graph.consolidated_edges(none), graph.communities(two, none)).first().modularity is None
