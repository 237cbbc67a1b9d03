"""Strongly connected components of small and large instances."""

import random

import pytest

from trajspark.operators import graphs


def tables(spark, edges, nodes=()):
    every = {(i, x) for i, a, b in edges for x in (a, b)} | set(nodes)
    return spark.createDataFrame(sorted(every), "instance_id string, node_key long"), spark.createDataFrame(edges, "instance_id string, caller long, callee long")


def closure(edges):
    """(instance, node) -> least node that it reaches and that reaches it, by following every edge from every node."""
    out, nodes = {}, {(i, x) for i, a, b in edges for x in (a, b)}
    for i, a, b in edges:
        out.setdefault((i, a), set()).add((i, b))
    reach = {}
    for n in nodes:
        todo, seen = [n], {n}
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return {n: min(m[1] for m in reach[n] if n in reach[m]) for n in nodes}, reach


def got(spark, edges, **more):
    nodes, e = tables(spark, edges)
    return {(r.instance_id, r.node_key): r.component for r in graphs.components(nodes, e, **more).collect()}


def some(seed, nodes, edges):
    rnd = random.Random(seed)
    return list({(f"g{rnd.randrange(2)}", rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(edges)})


@pytest.mark.parametrize("limit", [10**6, 8])
def test_random(spark, limit):
    edges = some(1, 40, 90) + [("h", i, i + 1) for i in range(30)] + [("h", 30, 12), ("h", 5, 5)]
    want, reach = closure(edges)
    assert got(spark, edges, limit=limit) == want
    nodes, e = tables(spark, edges)
    sinks = {n for n in want if all(want[n] == want[m] and n[0] == m[0] for m in reach[n])}
    assert {tuple(r) for r in graphs.terminal_nodes(nodes, e, limit=limit).collect()} == sinks


def test_colours(spark, monkeypatch):
    """A core in which no node has one way out, by colours alone."""
    monkeypatch.setattr(graphs, "SHRINKS", 1.0)
    edges = [("k", a, b) for a in range(6) for b in range(6) if a != b] + [("k", a + 10, b + 10) for a in range(4) for b in range(4) if a != b] + [("k", 1, 11), ("k", 2, 12), ("k", 30, 1), ("k", 30, 2)]
    assert got(spark, edges, limit=3) == closure(edges)[0]


def test_long_cycle(spark):
    """A cycle of 10,000 nodes with a tail, of which a task may hold 2,000 edges: shrunk in some rounds, without a table of pairs."""
    n = 10_000
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [("c", order[i], order[(i + 1) % n]) for i in range(n)] + [("c", n + i, n + i + 1) for i in range(200)] + [("c", n + 200, 7)]
    found = got(spark, edges, limit=2_000)
    assert len(found) == n + 201
    assert {found["c", i] for i in range(n)} == {0}
    assert all(found["c", n + i] == n + i for i in range(201))


def test_awkward(spark):
    nodes = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "instance_id string, node_key long")
    edges = spark.createDataFrame([("a", 1, 1), ("a", 1, 9), ("a", 9, 1), ("b", 1, 2)], "instance_id string, caller long, callee long")
    assert sorted(map(tuple, graphs.components(nodes, edges).collect())) == [("a", 1, 1), ("a", 2, 2)]
    assert graphs.components(nodes.where("false"), edges).collect() == []
    assert sorted(map(tuple, graphs.components(nodes, edges.where("false")).collect())) == [("a", 1, 1), ("a", 2, 2)]
