import random
from collections import Counter

import pytest

from millrace.operators import graph


@pytest.mark.parametrize("kind", ["long", "string"])
def test_gangs_in_tiles_are_those_of_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "MET", 50)
    monkeypatch.setattr(graph, "CELLS", 200)
    r = random.Random(2)
    name = (lambda i: f"m{i}") if kind == "string" else (lambda i: i * 10**12)
    rows = [(name(r.randrange(60)), r.randrange(25)) for _ in range(700)] + [(name(3), None), (None, 4)] + [(name(i), 99) for i in range(60)]
    edges = spark.createDataFrame(rows, f"member {kind}, target long")
    of = Counter((m, t) for m, t in rows if m is not None and t is not None)
    paths, shared = Counter(), Counter()
    for (a, t), n in of.items():
        for (b, u), k in of.items():
            if t == u and a < b:
                paths[a, b] += n * k
                shared[a, b] += 1
    for use, want, least in ((graph.gang_paths, paths, 8), (graph.gangs, shared, 4), (graph.gangs, shared, 1)):
        found = [tuple(x) for x in use(edges, least).collect()]
        assert len(found) == len(set(found)) and set(found) == {(*p, n) for p, n in want.items() if n >= least}
    assert graph.gangs(edges.limit(0)).count() == 0


def test_pairs_of_members_are_not_shuffled(spark):
    edges = spark.createDataFrame([(i, i % 3) for i in range(30)], "member long, target long")
    for use in (graph.gang_paths, graph.gangs):
        plan = use(edges)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "HashAggregate(keys=[a" not in plan


def test_shortest_paths_from_more_seeds_than_a_row_has_bits(spark, monkeypatch):
    monkeypatch.setattr(graph, "WORDS", 1)
    r = random.Random(5)
    ends = [(r.randrange(150), r.randrange(150, 190)) for _ in range(260)] + [(7, 7), (3, 160), (3, 160)]
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "edge long, src long, dst long")
    near = {}
    for a, b in ends:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for seed in range(150):
        length, front = {seed: 0}, {seed}
        for k in range(1, 5):
            front = {n for f in front for n in near.get(f, ())} - length.keys()
            length |= dict.fromkeys(front, k)
        want |= {(seed, n, k) for n, k in length.items()}
    seeds = spark.createDataFrame([(i,) for i in range(150)], "seed long")
    found = graph.shortest_lengths(edges, seeds, 4)
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert {tuple(x) for x in graph.neighbourhood(edges, seeds, 3).collect()} == {x for x in want if 0 < x[2] < 4}
    assert graph.shortest_lengths(edges, seeds.limit(0), 2).count() == 0


def _lengths(ends, seeds, most):
    """Breadth first in plain Python; no path goes on from a null."""
    near = {}
    for a, b in ends:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    near.pop(None, None)
    want = set()
    for seed in seeds:
        length, front = {seed: 0}, {seed}
        for k in range(1, most + 1):
            front = {n for f in front for n in near.get(f, ())} - length.keys()
            length |= dict.fromkeys(front, k)
        want |= {(seed, n, k) for n, k in length.items()}
    return want


@pytest.mark.parametrize("kind, narrow, turned", [("long", 10**6, False), ("long", 0, True), ("string", 0, False)])
def test_shortest_paths_over_a_cover_with_nulls_heavy_nodes_and_seeds_of_both_sides(spark, monkeypatch, kind, narrow, turned):
    for name, value in (("WORDS", 2), ("HEAVY", 6), ("NARROW", narrow), ("EDGES", 40), ("NODES", 7), ("ROWS_AT_ONCE", 3), ("PARTS", 2), ("TILES", 3)):
        monkeypatch.setattr(graph, name, value)
    r = random.Random(9)
    ends = [(r.randrange(200), r.randrange(190, 230)) for _ in range(240)] + [(1, 215)] * 3 + [(2, h) for h in range(190, 200)] + [(4, 4), (5, None), (None, 191), (None, 7), (None, None), (199, 200)]
    of = (lambda i: i if i is None else f"n{i}") if kind == "string" else (lambda i: i)
    ends = [(of(b), of(a)) if turned else (of(a), of(b)) for a, b in ends]
    seeds = [of(i) for i in (*range(0, 200, 2), 195, 201, 900)]
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], f"edge long, src {kind}, dst {kind}")
    found = graph.shortest_lengths(edges, spark.createDataFrame([(s,) for s in seeds] * 2, f"seed {kind}"), 5)
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _lengths(ends, seeds, 5)


def test_a_search_writes_no_row_of_a_node_outside_of_the_cover(spark, monkeypatch):
    written = []

    def counted(df, use=graph.checkpointed):
        out = use(df)
        if "w0" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", counted)
    edges = spark.range(3000).selectExpr("id AS edge", "id % 1000 AS src", "100000 + id % 7 AS dst")
    found = graph.shortest_lengths(edges, spark.range(0, 1000, 10).toDF("seed"), 4)
    assert found.count() == 100 * 1007 and max(written) <= 7


@pytest.mark.parametrize("kind, of", [("long", "long"), ("string", "string"), ("string", "int")])
def test_gangs_of_many_pairs_read_blocks_and_shuffle_none(spark, monkeypatch, kind, of):
    for name, value in (("FEW_PAIRS", 0), ("PAIRS_OF_BLOCK", 30), ("BLOCKS_OF_PART", 2), ("PARTS", 2), ("MET", 40), ("CELLS", 20), ("BUCKETS", 3)):
        monkeypatch.setattr(graph, name, value)
    r = random.Random(3)
    name = (lambda i: f"m{i}") if kind == "string" else (lambda i: i * 10**12 - 30)
    target = (lambda i: f"t{i}") if of == "string" else (lambda i: i - 5)
    rows = [(name(r.randrange(60)), target(r.randrange(25))) for _ in range(500)] + [(name(3), None), (None, target(4))] + [(name(i), target(99)) for i in range(60)]
    edges = spark.createDataFrame(rows, f"member {kind}, target {of}")
    n = Counter((m, t) for m, t in rows if m is not None and t is not None)
    paths, shared = Counter(), Counter()
    for (a, t), x in n.items():
        for (b, u), y in n.items():
            if t == u and a < b:
                paths[a, b] += x * y
                shared[a, b] += 1
    for use, want, least in ((graph.gang_paths, paths, 8), (graph.gangs, shared, 4), (graph.gangs, shared, 1)):
        out = use(edges, least)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        found = [tuple(x) for x in out.collect()]
        assert len(found) == len(set(found)) and set(found) == {(*p, k) for p, k in want.items() if k >= least}
