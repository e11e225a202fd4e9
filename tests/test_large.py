"""Graphs beyond a row, hubs, canonical forms and cycles, against kernels and plain loops."""

import random
import time
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from graphloom import large
from graphloom import operators as O
from graphloom.functions import kernels as K

from .test_operators import collection, sets


@pytest.fixture(autouse=True)
def beyond_a_row(monkeypatch):
    """Every graph counts as one of many nodes here, so that the joins are what is tested."""
    monkeypatch.setattr(large, "ROW_ITEMS", 0)


def random_graphs(seed, count=4, most=11, directed=False):
    """Node and edge rows of some graphs, sparse and dense, in parts or not."""
    rng, out = random.Random(seed), []
    for g in range(count):
        n = rng.randint(1, most)
        pairs = permutations(range(n), 2) if directed else combinations(range(n), 2)
        p = rng.choice([0.15, 0.3, 0.6])
        out.append((g, list(range(n)), [x for x in pairs if rng.random() < p]))
    return out


def tables(spark, graphs):
    nodes = spark.createDataFrame([(g, n) for g, ns, _ in graphs for n in ns], "graph_id long, node_id long")
    return nodes, spark.createDataFrame([(g, u, v) for g, _, es in graphs for u, v in es], "graph_id long, src long, dst long")


def members(df):
    return sorted((r.graph_id, *r.members) for r in df.collect())


@pytest.fixture(params=[4_096, 2])
def hub_rows(request, monkeypatch):
    """Joins by members as they are, and with nearly every key dealt to blocks."""
    monkeypatch.setattr(large, "HUB_ROWS", request.param)


def test_cliques_and_graphlets(spark, hub_rows):
    graphs = random_graphs(1)
    nodes, edges = tables(spark, graphs)
    each = [(g, K.Graph(ns, es, False)) for g, ns, es in graphs]
    assert members(large.cliques(nodes, edges, 1, 4)) == sorted((g, *sorted(c)) for g, x in each for c in K.cliques(x, 1, 4))
    assert members(large.cliques(nodes, edges, 3, 3)) == sorted((g, *sorted(c)) for g, x in each for c in K.cliques(x, 3, 3))
    assert members(large.graphlets(nodes, edges, 1, 2, 4)) == sorted((g, *sorted(c)) for g, x in each for c in K.graphlets(x, 1, 2, 4))


OPERATORS = {
    "components": lambda n, e: large.components(n, e), "within": lambda n, e: large.within(n, e, 2), "directed": lambda n, e: large.within(n, e, 2, True), "geodesics": lambda n, e: large.geodesics(n, e, 1, 3),
    "cliques": lambda n, e: large.cliques(n, e, 1, 4), "graphlets": lambda n, e: large.graphlets(n, e, 1, 1, 3), "trees": lambda n, e: large.trees(n, e), "cycles": lambda n, e: large.cycles(n, e).select("graph_id", "src", "dst").distinct(),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_small_graphs_are_worked_out_whole(spark, monkeypatch, name):
    """The same by joins, whole, and with graphs of both kinds; whole, nothing is shuffled but the graphs themselves."""
    nodes, edges = tables(spark, random_graphs(4, 5))
    edges = edges.unionByName(edges).unionByName(nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    rows = lambda: OPERATORS[name](nodes, edges)
    plain = lambda df: [tuple(map(tuple, [x if isinstance(x, list) else [x] for x in r])) for r in df.collect()]
    by_joins = rows()
    parts = dict.fromkeys(by_joins.columns)
    for most in (14, 2_000):
        monkeypatch.setattr(large, "ROW_ITEMS", most)
        found = rows()
        assert list(parts) == found.columns and sorted(plain(found), key=repr) == sorted(plain(by_joins), key=repr) != []
    exchanges = found._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges <= (2 if name != "cycles" else 4)


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness(spark, directed):
    graphs = random_graphs(2, directed=directed)
    found = {(r.graph_id, r.node_id): r.score for r in large.betweenness(*tables(spark, graphs), directed).collect()}
    assert found == pytest.approx({(g, n): x for g, ns, es in graphs for x, n in K.betweenness(K.Graph(ns, es, directed))}, abs=1e-6)


def test_forests_bridges_and_cycles(spark):
    graphs = [*random_graphs(3, 3), (10, list(range(9)), [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7)])]
    nodes, edges = tables(spark, graphs)
    each = [(g, K.Graph(ns, es, False)) for g, ns, es in graphs]
    assert sorted((r.graph_id, r.src, r.dst) for r in large.bridges(nodes, edges).collect()) == sorted((g, *b) for g, x in each for b in K.bridges(x))
    found = large.trees(nodes, edges).groupBy("graph_id", "component").agg(F.sort_array(F.collect_list("node_id")).alias("members"))
    assert sorted((r.graph_id, *r.members) for r in found.collect()) == sorted((g, *t) for g, x in each for t in K.trees(x))
    rings = large.cycles(nodes, edges).groupBy("graph_id", "src", "dst").agg(F.collect_list("node_id").alias("members")).collect()
    assert {g: sum(r.graph_id == g for r in rings) for g, _ in each} == {g: len(list(K.cycles(x))) for g, x in each}
    for r in rings:  # each is a closed walk: all its nodes have two neighbours or more in it, and it hangs together
        part = dict(each)[r.graph_id].part(r.members)
        assert len(K.components(part)) == 1 and all(len(part.near[n]) >= 2 for n in part.nodes) and {r.src, r.dst} <= set(r.members)


def test_members_that_meet(spark, hub_rows):
    """Every operator that pairs subgraphs by a common node, one of which stands in most of them."""
    star = [(0, i) for i in range(1, 9)] + [(1, 2), (3, 4)]
    ag = collection(spark, "x" * 9, star)
    edges = O.forward_compose(O.edge())(ag)
    assert sets(O.intersection()(edges)) == [(n,) for n in range(5)]
    links = O.intersection_edges()(edges)
    assert links.links.count() == sum(bool({*a} & {*b}) for a, b in combinations(star, 2))
    near = O.intersection_edges(accept_connection_by_edge=True)(O.node()(ag))
    assert near.links.count() == len(star)
    kept = O.remove_redundant_mapped_subgraphs()(O.clique((1, 3))(ag))
    assert sets(kept) == [(0, 1, 2), (0, 3, 4), (0, 5), (0, 6), (0, 7), (0, 8)]
    both = O.compose_product(O.binary_intersection(must_be_connected=False, first_second_node_size=(1, 9)), O.edge(), O.neighborhood(1))(ag)
    balls = {tuple(sorted({n, *(v for e in star for v in e if n in e)})) for n in range(9)}
    assert sets(both) == sorted({tuple(sorted({*e} & {*b})) for e in star for b in balls if {*e} & {*b}})


def test_a_hub_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(large, "HUB_ROWS", 100)
    rows = spark.range(1_000).selectExpr("1L AS graph_id", "id AS u", "7L AS n")
    pairs = large.met(rows, rows.select("graph_id", F.col("u").alias("v"), "n"), ["graph_id", "n"])
    a, b, keys = large.dealt(rows, rows.withColumnRenamed("u", "v"), ["graph_id", "n"])
    assert pairs.count() == 1_000_000 and a.select(keys).distinct().count() == 100 == b.select(keys).distinct().count()


def shuffled(n, edges, labels, directed, rng):
    p = rng.sample(range(n), n)
    return {p[i]: labels[i] for i in range(n)}, {(p[u], p[v]) if directed else (min(p[u], p[v]), max(p[u], p[v])): x for (u, v), x in edges.items()}


SYMMETRIC = {
    "complete": (30, list(combinations(range(30), 2))), "bipartite": (20, [(i, 10 + j) for i in range(10) for j in range(10)]), "cube": (16, [(i, i ^ 1 << k) for i in range(16) for k in range(4) if i < i ^ 1 << k]),
    "petersen": (10, [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)]),
    "squares": (24, [(4 * g + a, 4 * g + (a + 1) % 4) for g in range(6) for a in range(4)]), "circle": (40, [(i, (i + 1) % 40) for i in range(40)]),
}


@pytest.mark.parametrize("name", SYMMETRIC)
def test_canonical_of_symmetric_graphs(name):
    n, pairs = SYMMETRIC[name]
    edges, rng, began = {(min(e), max(e)): "e" for e in pairs}, random.Random(1), time.perf_counter()
    assert len({K.canonical(*shuffled(n, edges, "x" * n, False, rng), False) for _ in range(50)}) == 1
    assert time.perf_counter() - began < 50
    assert K.canonical(dict.fromkeys(range(n), "x"), dict(list(edges.items())[1:]), False) != K.canonical(dict.fromkeys(range(n), "x"), edges, False)


def test_canonical_tells_apart_what_is_different():
    """Against all permutations: equal certificates are isomorphic graphs, and the other way round."""
    rng = random.Random(7)
    for _ in range(250):
        n, directed = rng.randint(1, 5), rng.random() < 0.5

        def make(n=n, directed=directed):
            pairs = permutations(range(n), 2) if directed else combinations(range(n), 2)
            return {p: rng.choice("ee f"[:rng.choice([1, 4])]) for p in pairs if rng.random() < 0.5}, [rng.choice("xy"[:rng.choice([1, 2])]) for _ in range(n)]

        (a, x), (b, y) = make(), make()
        if rng.random() < 0.5:
            names, b = shuffled(n, a, x, directed, rng)
            y = [names[i] for i in range(n)]
        moved = lambda p: {(p[u], p[v]) if directed else (min(p[u], p[v]), max(p[u], p[v])): k for (u, v), k in a.items()}  # noqa: E731, B023
        same = any(moved(p) == b and all(x[i] == y[p[i]] for i in range(n)) for p in permutations(range(n)))
        assert (K.canonical(dict(enumerate(x)), a, directed) == K.canonical(dict(enumerate(y)), b, directed)) == same


def test_directed_cycles():
    rng = random.Random(8)

    def plain(n, arcs):
        out, found = {i: [v for u, v in arcs if u == i] for i in range(n)}, []

        def go(path):
            for v in out[path[-1]]:
                if v == path[0]:
                    found.append(sorted(path))
                elif v > path[0] and v not in path:
                    go([*path, v])

        for s in range(n):
            go([s])
        return sorted(found)

    for _ in range(200):
        n, p = rng.randint(1, 7), rng.choice([0.1, 0.3, 0.6])
        arcs = [x for x in permutations(range(n), 2) if rng.random() < p]
        assert sorted(K.cycles(K.Graph(range(n), arcs, True))) == plain(n, arcs)
    assert list(K.cycles(K.Graph(range(500), list(combinations(range(500), 2)), True))) == []
