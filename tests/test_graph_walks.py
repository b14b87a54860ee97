"""Walks over graphs with cycles against plain Python."""

import random

from lodestone.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "node_id string, next_node_id string")


def closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    far = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), list(after.get(a, ()))
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after.get(b, ())
        far[a] = seen
    return after, far


def test_random_graphs(spark):
    rng = random.Random(7)
    for n, m in ((9, 12), (14, 22), (12, 9)):
        edges = sorted({(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)})
        after, far = closure(edges)
        depth, level, d = {}, {"v00"}, 0
        while level:
            depth |= dict.fromkeys(level, d)
            level = {b for a in level for b in after.get(a, ())} - set(depth)
            d += 1
        roots = spark.createDataFrame([("v00",), (None,)], "node_id string")
        assert {r["node_id"]: r["depth"] for r in graph.reached(frame(spark, [*edges, (None, "v01")]), roots).collect()} == depth
        want = {a: min([b for b in far[a] if a in far[b]]) for a in far if a in far[a]}
        assert {r["node_id"]: r["component"] for r in graph.cycles(frame(spark, edges)).collect()} == want


def test_no_edges_and_findings(spark):
    assert graph.cycles(frame(spark, [])).count() == 0
    edges = frame(spark, [("r", "m"), ("m", "r"), ("m", "e"), ("m", "x"), ("i", "e"), ("j", None)])
    nodes = spark.createDataFrame([(x,) for x in "rmexij"], "node_id string")
    got = graph.findings(nodes, edges, spark.createDataFrame([("r",)], "node_id string"), spark.createDataFrame([("e",)], "node_id string"))
    assert {tuple(r) for r in got.collect()} == {("r", 0, False), ("m", 1, False), ("e", 2, False), ("x", 2, True), ("i", None, False), ("j", None, True)}
