"""Strongly connected components, cycles and depths against brute force on small graphs."""

import random

from weftline.operators import graph


def _reached(edges, node):
    seen, front = set(), {node}
    while front:
        front = {b for a, b in edges if a in front} - seen
        seen |= front
    return seen


def _components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: _reached(edges, n) for n in nodes}
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


def _frame(spark, edges):
    return spark.createDataFrame([(a, b) for a, b in edges], "a int, b int")


def test_nodes_between_cycles_are_on_none(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (5, 6), (7, 1), (8, 8)]
    got = {r["node"]: r["component"] for r in graph.components(_frame(spark, [*edges, (1, 2)]), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4, 8: 8}
    assert {r["node"] for r in graph.on_cycle(_frame(spark, edges), "a", "b").collect()} == {1, 2, 4, 5, 8}


def test_components_of_random_graphs(spark):
    r = random.Random(7)
    edges, at = [], 0
    for _ in range(12):  # many graphs in one frame
        n = r.randrange(2, 8)
        edges += [(at + r.randrange(n), at + r.randrange(n)) for _ in range(r.randrange(1, 2 * n))]
        at += n
    got = {x["node"]: x["component"] for x in graph.components(_frame(spark, edges), "a", "b").collect()}
    assert got == _components(edges)


def test_components_of_chains_and_rings(spark, monkeypatch):
    """Rounds don't grow with the length of a chain or ring."""
    cuts, plain = [0], graph.Rounds.put

    def counted(self, df):
        cuts[0] += 1
        return plain(self, df)

    monkeypatch.setattr(graph.Rounds, "put", counted)
    edges = [(i, (i + 1) % 60) for i in range(60)] + [(i, (i + 20) % 60) for i in range(0, 60, 20)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 1000)]
    got = {x["node"]: x["component"] for x in graph.components(_frame(spark, edges), "a", "b").collect()}
    assert got == {i: 0 for i in range(60)} and cuts[0] < 70, cuts


def test_nothing_and_nulls(spark):
    assert graph.components(_frame(spark, []), "a", "b").count() == 0
    assert graph.components(spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int"), "a", "b").count() == 0


def _depth(edges, root, deepest):
    best, stack = 0, [(root, (root,))]
    while stack:
        at, met = stack.pop()
        best = max(best, len(met) - 1)
        if len(met) <= deepest:
            stack += [(b, (*met, b)) for a, b in edges if a == at and b not in met]
    return best


def test_depths_of_graphs_with_cycles(spark):
    r = random.Random(3)
    edges, at = set(), 0
    for _ in range(12):
        n = r.randrange(3, 8)
        edges |= {(at + r.randrange(n), at + r.randrange(n)) for _ in range(n + 2)}
        edges |= {(1000 + at, at + r.randrange(n)), (at + r.randrange(n), 2000 + at), (2000 + at, 2001 + at)}
        at += n
    heads = {b for _, b in edges}
    want = {a: _depth(edges, a, 6) for a, _ in edges if a not in heads}
    assert {x["root"]: x["depth"] for x in graph.longest_path(_frame(spark, sorted(edges)), "a", "b", deepest=6).collect()} == want


def test_ancestors_of_deep_chains(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)] + [(100, 101), (101, 100)], "id int, p int")
    got = {(r["id"], r["ancestor"]): r["distance"] for r in graph.ancestors(chain, "id", "p").collect()}
    assert got == {(i, j): i - j for i in range(70) for j in range(i)} | {(100, 101): 1, (101, 100): 1, (100, 100): 2, (101, 101): 2}


def test_rounds_end_with_the_ways_into_cycles(spark, monkeypatch):
    """However many nodes there are: the rounds are those of the longest way in."""
    puts, put = [], graph.Rounds.put
    monkeypatch.setattr(graph.Rounds, "put", lambda self, df: puts.append(1) or put(self, df))
    rings = [(i, i - i % 3 + (i + 1) % 3) for i in range(3000)] + [(10000 + i, i) for i in range(500)] + [(20000, 20001), (30000, 30001), (30001, 30001)]
    assert {r["node"] for r in graph.on_cycle(_frame(spark, rings), "a", "b").collect()} == {*range(3000), 30001}
    assert len(puts) <= 3


def test_only_what_the_roots_reach_is_searched(spark, monkeypatch):
    seen, components = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e, a, b: seen.append(e.count()) or components(e, a, b))
    edges = [(1000 * i + k, 1000 * i + k + 1) for i in range(40) for k in range(4)] + [(2, 0)]
    got = {r["root"]: r["depth"] for r in graph.longest_path(_frame(spark, edges + edges), "a", "b", roots=2, deepest=3).collect()}
    assert got == {1000: 3, 2000: 3} and seen == [6]


def test_cycles_of_neighbours_leave_before_the_rounds(spark, monkeypatch):
    """Rings, apart and in a chain, as numbers and as text: what the rounds see does not grow with them, wherever a chunk ends."""
    seen, plain = [], graph._without_dead_ends
    monkeypatch.setattr(graph, "_without_dead_ends", lambda e: seen.append(e.count()) or plain(e))
    edges = [(i, i - i % 5 + (i + s) % 5) for i in range(4000) for s in (1, 3)] + [(i, i + 6) for i in range(0, 1000, 5)] + [(3000, 3000), (9000, 9000)]
    got = {x["node"]: x["component"] for x in graph.components(_frame(spark, edges), "a", "b").collect()}
    assert got == {i: i - i % 5 for i in range(4000)} | {9000: 9000} and seen[0] < 300, seen
    text = spark.createDataFrame([(f"é{a:05}", f"é{b:05}") for a, b in edges], "a string, b string")
    assert {x["node"]: x["component"] for x in graph.components(text, "a", "b").collect()} == {f"é{a:05}": f"é{b:05}" for a, b in got.items()}


def test_components_wherever_chunks_end(spark, monkeypatch):
    """Batches of a few edges: each chunk shows but a part of most components."""
    r = random.Random(11)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(100)] + [(7, x) for x in range(0, 90, 4)] + [(x, x) for x in (3, 7, 88)]
    want = _components(edges)
    monkeypatch.setattr(graph, "CHUNK_EDGES", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "20"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {x["node"]: x["component"] for x in graph.components(_frame(spark, edges), "a", "b").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_strong_components_against_reachability():
    r = random.Random(5)
    for _ in range(200):
        n = r.randrange(1, 9)
        edges = sorted((r.randrange(n), r.randrange(n)) for _ in range(r.randrange(2 * n)))
        root = graph.strong([sum(a < v for a, _ in edges) for v in range(n + 1)], [b for _, b in edges])
        reach = [{v} | _reached(edges, v) for v in range(n)]
        assert all((root[v] == root[w]) == (v in reach[w] and w in reach[v]) for v in range(n) for w in range(n))
