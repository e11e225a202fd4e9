"""Operators on small graphs whose results are known."""

from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from graphloom import operators as O
from graphloom.functions import kernels as K
from graphloom.functions import labels as L
from graphloom.model import from_tables
from graphloom.operators.structure import global_edges, global_nodes, local_edges, local_nodes

#: A triangle and a square on one path that ends in a tail, and a node by itself.
KITE = "pqrpqrsspt", [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 6), (6, 7), (7, 8)]
NODES, EDGES = range(len(KITE[0])), KITE[1]


def collection(spark, labels, edges, directed=False, graph_id=1):
    n = spark.createDataFrame([(graph_id, i, x) for i, x in enumerate(labels)], "graph_id long, node_id long, label string")
    e = spark.createDataFrame([(graph_id, a, b, "-") for a, b in edges], "graph_id long, src long, dst long, label string")
    return from_tables(n, e, directed)


@pytest.fixture(scope="module")
def kite(spark):
    return collection(spark, *KITE)


def sets(ag):
    return sorted(tuple(r.nodes) for r in ag.sg.select("nodes").collect())


class Plain:
    """What the operators give on the kite, from a table of all distances and by looking at all subsets."""

    def __init__(self):
        self.far = {(u, v): 0 if u == v else 1 if (u, v) in EDGES or (v, u) in EDGES else 99 for u in NODES for v in NODES}
        for w in NODES:
            for u in NODES:
                for v in NODES:
                    self.far[u, v] = min(self.far[u, v], self.far[u, w] + self.far[w, v])

    def balls(self, *radii):
        return [tuple(v for v in NODES if self.far[u, v] <= r) for r in radii for u in NODES]

    def subsets(self, *sizes):
        return [c for k in sizes for c in combinations(NODES, k)]

    def connected(self, some):
        left, seen = set(some), {some[0]}
        while fresh := {v for v in left - seen if any(self.far[u, v] == 1 for u in seen)}:
            seen |= fresh
        return seen == left

    def cliques(self, *sizes):
        return [c for c in self.subsets(*sizes) if all(self.far[p] == 1 for p in combinations(c, 2))]

    def graphlets(self, radius, *sizes):
        return [c for c in self.subsets(*sizes) if self.connected(c) and any(all(self.far[u, v] <= radius for v in c) for u in NODES)]

    def paths(self, length):
        return {tuple(sorted(p)) for p in permutations(NODES, length + 1) if self.far[p[0], p[-1]] == length and all(self.far[p[i], p[i + 1]] == 1 for i in range(length))}

    def between(self, *lengths):
        return [tuple(w for w in NODES if self.far[u, w] + self.far[w, v] == self.far[u, v]) for u, v in combinations(NODES, 2) if self.far[u, v] in lengths]

    def unions(self, sets, low, high):
        return {tuple(sorted({*a, *b})) for a, b in combinations(sets, 2) if low <= min(self.far[u, v] for u in a for v in b) <= high}


plain = Plain()


@pytest.mark.parametrize(("op", "expected"), [
    (O.node(), plain.subsets(1)), (O.edge(), EDGES), (O.connected_component(), [(9,), tuple(range(9))]), (O.neighborhood(1), plain.balls(1)), (O.forward_compose(O.neighborhood(1)), set(plain.balls(1))),
    (O.forward_compose(O.neighborhood((0, 1))), set(plain.balls(0, 1))), (O.forward_compose(O.neighborhood((0, 2))), set(plain.balls(0, 1, 2))),
    (O.path(1), plain.paths(1)), (O.path(2), plain.paths(2)), (O.path(3), plain.paths(3)), (O.path(4), plain.paths(4)),
    (O.graphlet(1, (1, 3)), plain.graphlets(1, 1, 2, 3)), (O.graphlet(1, (4, 4)), plain.graphlets(1, 4)), (O.clique((1, 3)), plain.cliques(1, 2, 3)), (O.union_of_shortest_paths((1, 3)), plain.between(1, 2, 3)),
    (O.forward_compose(O.edge(), O.combination((2, 2), (0, 1))), plain.unions(EDGES, 0, 1)), (O.forward_compose(O.node(), O.combination((2, 2), (2, 2))), plain.unions(plain.subsets(1), 2, 2)),
    (O.degree((0, 2)), [(0, 1, 4, 5, 7, 8, 9)]), (O.cycle(), [(0, 1, 2), (3, 4, 5, 6)]), (O.tree(), [(2, 3), (6, 7, 8)]),
    (O.forward_compose(O.add(O.cycle(), O.tree()), O.intersection()), [(2,), (3,), (6,)]), (O.forward_compose(O.cycle(), O.merge()), [tuple(range(7))]),
    (O.forward_compose(O.cycle(), O.complement()), [(0, 1, 2, 7, 8, 9), (3, 4, 5, 6, 7, 8, 9)]),
])
def test_sets(kite, op, expected):
    assert sets(op(kite)) == sorted(expected)


def test_links(kite):
    found = O.forward_compose(O.edge(), O.intersection_edges())(kite)
    assert (found.sg.count(), found.links.count()) == (len(EDGES), sum(bool({*a} & {*b}) for a, b in combinations(EDGES, 2)))


def test_partitions_cover_and_connect(kite):
    for op in (O.split(3), O.low_cut_partition(max_part_size=4, min_overlap_nodes=0)):
        parts = sets(op(kite))
        assert sorted(n for p in parts for n in p) == list(NODES)
        g = K.Graph(NODES, EDGES, False)
        assert all(len(K.components(g.part(p))) == 1 for p in parts)


def test_directed(spark):
    ag = collection(spark, "PQRS", [(0, 1), (1, 0), (1, 2), (2, 3), (3, 0)], True)
    assert all(r.n == 2 if r.m == [0, 1] else r.n == 1 for r in O.edge()(ag).sg.select(F.col("nodes").alias("m"), F.size("edges").alias("n")).collect() if r.m)
    assert sets(O.cycle()(ag)) == [(0, 1), (0, 1, 2, 3)]
    with pytest.raises(ValueError):
        O.clique()(ag)
    assert len(sets(O.add(O.node(), O.edge())(ag))) > 3
    weak = collection(spark, "PQRST", [(0, 1), (2, 1), (4, 3)], True)
    assert sets(O.connected_component()(weak)) == [(0, 1, 2), (3, 4)]


def test_local_edge_complement(spark):
    ag = collection(spark, "ABC", [(0, 1), (1, 2), (2, 0)], True)
    two = local_edges(ag, lambda g: [[(0, 1)], [(1, 2)]], "two")
    left = O.local_edge_complement()(two).sg.collect()
    assert [[(e.src, e.dst) for e in r.edges] for r in left] == [[(2, 0)]]


def test_custom_operators(spark):
    ag = collection(spark, "ABCD", [(0, 1), (1, 2), (2, 3)])
    assert sets(local_nodes(ag, lambda g: [[1, 2]], "mine")) == [(1, 2)]
    assert sets(local_nodes(ag, lambda g: [[], [1]], "mine", skip_empty=True)) == [(1,)]
    assert sets(global_nodes(O.edge()(ag), lambda every, base: [[len(every)]], "count")) == [(3,)]
    with pytest.raises(Exception, match="list of components"):
        local_nodes(ag, lambda g: (x for x in [[1]]), "mine").sg.collect()


def test_hash_tells_graphs_apart():
    """The triangular prism and K3,3: both have six nodes of three neighbours."""
    prism = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)]
    bipartite = [(u, v) for u in (0, 2, 4) for v in (1, 3, 5)]
    code = lambda edges, names=range(6): K.canonical(dict.fromkeys(range(6), "x"), {(names[u], names[v]): "" for u, v in edges}, False)
    assert code(prism) != code(bipartite)
    assert code(prism) == code(prism, [4, 2, 0, 5, 3, 1]) and code(bipartite) == code(bipartite, [3, 0, 5, 1, 2, 4])
    one = {0: "a", 1: "b"}
    assert len({K.canonical(one, {(0, 1): "x"}, False), K.canonical(one, {(0, 1): "x"}, True), K.canonical(one, {(1, 0): "x"}, True)}) == 3
    assert all(2 <= K.bounded(str(i), 4) <= 15 for i in range(100))


def test_features(kite):
    ag = L.apply(kite, O.forward_compose(O.edge()), 8)
    rows = {(r.node_id, r.col): r.value for r in L.vectorize(ag).collect()}
    assert all(rows[n, 0] == 1 and rows[n, 1] == sum(n in e for e in EDGES) for n in NODES)
    graph = {r.col: r.value for r in L.vectorize_graphs(ag).collect()}
    assert graph[0] == len(NODES) and graph[1] == 2 * len(EDGES)
    assert L.GraphHashDeduper().fit(kite).filter(kite).count() == 0


def test_labels_have_versions(kite):
    kept = O.forward_compose(O.node())(O.unlabel()(kite))
    real = O.restore_label()(kept)
    assert {x.label for r in L.with_labels(real, real.sg).collect() for x in r.node_labels} == {"-"}
    assert real.version == 2


def test_control_flow(kite):
    few = lambda ag: O.number_of_interpretation_graph_nodes()(ag).select("graph_id", F.col("value") < 5)
    assert len(sets(O.if_then_else(few, O.node(), O.edge())(kite))) == len(NODES)
    large = lambda ag: O.max_number_of_subgraph_nodes()(ag).select("graph_id", F.col("value") > 2)
    assert {len(s) for s in sets(O.while_loop(O.edge(), large)(kite))} == {2}
    assert len(sets(O.for_loop(O.identity(), n_iterations=3)(kite))) == 1


def test_global_edges(spark):
    ag = collection(spark, "ABCDE", [(0, 1), (1, 2), (2, 3), (3, 4)])
    first_last = lambda graphs, base: [[graphs[0].edges[0], graphs[-1].edges[0]], []]
    made = global_edges(O.edge()(ag), first_last, "ends", skip_empty=True)
    assert [sorted((e.src, e.dst) for e in r.edges) for r in made.sg.collect()] == [[(0, 1), (3, 4)]]
    assert global_edges(O.edge()(ag), first_last, "ends").sg.count() == 2


def test_names(kite):
    assert {r.u for r in O.name("mine")(kite).sg.select(F.col("meta.user_name").alias("u")).collect()} == {"mine"}
    assert L.name_hash(O.name("mine")(kite), 10).sg.filter("label IS NULL").count() == 0
    assert kite.sg.filter("meta IS NULL").count() == 0


def test_added_rewriters_keep_their_labels(kite):
    both = O.add(O.forward_compose(O.unlabel("-"), O.node()), O.edge(), O.forward_compose(O.prepend_label("p:"), O.prepend_label("q:"), O.node()))(kite)
    rows = L.with_labels(both, both.sg).collect()
    labels = lambda some: {x.label for r in some for x in r.node_labels}
    assert labels(r for r in rows if len(r.nodes) == 2) == set("pqrs")
    assert labels(r for r in rows if len(r.nodes) == 1) == {"-", *(f"q:p:{x}" for x in "pqrst")}
    again = O.unlabel("z")(both)
    new = O.node()(again)
    assert labels(L.with_labels(new, new.sg).collect()) == {"z"} and labels(L.with_labels(again, again.sg).collect()) == labels(rows)


def test_label_keys(kite):
    pre = O.forward_compose(O.prepend_label("p:"), O.node())(kite)
    assert O.filter_by_node_label(key="original_label", must_have_one_of=["t"])(pre).sg.count() == 1
    assert O.filter_by_node_label(must_have_one_of=["t"])(pre).sg.count() == 0
    assert O.filter_by_node_label(key="nokey", must_have_one_of=["t"])(pre).sg.count() == 0
    assert O.filter_by_node_label(key="nokey", must_have_one_of=["0"])(pre).sg.count() == len(NODES)
    assert O.filter_by_edge_label(key="nokey", cannot_have_any_in=["0"])(O.edge()(pre)).sg.count() == 0


def test_sampling_a_whole_graph(kite):
    parts = sets(O.filter_by_sampling(3, 1)(kite))
    g = K.Graph(NODES, EDGES, False)
    assert len(parts) == 3 and all(len(K.components(g.part(p))) == 1 for p in parts)
    assert len(sets(O.filter_by_sampling(3, 1)(O.edge()(kite)))) == 3


def test_local_complement_finds_its_parent(kite):
    rings = O.cycle()(kite)
    assert sets(O.local_complement()(O.degree((4, 9))(rings))) == [(0, 1, 2), (3, 4, 5, 6)]  # no node of a ring has four neighbours in it
    whole = O.local_complement()(O.filter_by_number_of_nodes((4, 4))(rings))
    assert sets(whole) == [(0, 1, 2, 7, 8, 9)]


def test_custom_edges_stay_apart(spark):
    ag = collection(spark, "ABC", [(0, 1), (1, 2), (0, 2)])
    path = local_edges(ag, lambda g: [[(0, 1), (1, 2)]], "path")
    assert [len(r.edges) for r in path.sg.collect()] == [2]
    assert [len(r.edges) for r in O.filter_by_number_of_nodes((1, 9))(path).sg.collect()] == [3]


def test_large_graphs(spark, kite):
    from graphloom import large

    base = kite.base
    nodes = base.select("graph_id", F.explode("nodes").alias("x")).select("graph_id", F.col("x.id").alias("node_id"))
    edges = base.select("graph_id", F.explode("edges").alias("x")).select("graph_id", "x.src", "x.dst")
    assert {r.node_id for r in large.degrees(nodes, edges).filter("degree = 3").collect()} == {2, 3, 6}
    line = spark.range(200).selectExpr("1L AS graph_id", "id AS node_id"), spark.range(199).selectExpr("1L AS graph_id", "id AS src", "id + 1 AS dst")
    assert {r.component for r in large.components(*line).collect()} == {0}
    lone = nodes.unionByName(spark.createDataFrame([(1, 99)], "graph_id long, node_id long"))
    assert {r.component for r in large.components(lone, edges).collect()} == {0, 9, 99}
    g = K.Graph(NODES, EDGES, False)
    for low, high in ((1, 1), (2, 2), (3, 4)):
        assert {tuple(r.members) for r in large.geodesics(nodes, edges, low, high).collect()} == {tuple(p) for p in K.geodesics(g, low, high)}
    ball = {(r.centre, r.node_id): r.hops for r in large.within(nodes, edges, 2).collect()}
    assert ball == {(n, m): d for n in NODES for m, d in K.distances(g.near, n, 2).items()}
    some, inner = large.merged(spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 2)], "graph_id long, sg_id long, node_id long"), edges)
    assert some.count() == 3 and {(r.src, r.dst) for r in inner.collect()} == {(0, 1), (0, 2), (1, 2)}


def test_close_sets():
    ring = K.Graph(range(6), [(i, (i + 1) % 6) for i in range(6)], False)
    some = [[0], [1, 2], [3], [5]]
    assert K.close_sets(ring, 1, 1, some, some, True) == [{1, 3}, {0, 2}, {1}, {0}]
    chain = K.Graph(range(3), [(0, 1), (1, 2)], True)
    assert K.close_sets(chain, 0, 2, [[0], [2]], [[2], [0]]) == [{0, 1}, {0}]


def test_streams(spark, kite, tmp_path):
    from graphloom.streaming import features_stream, label_windows

    kite.base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kite.base.schema).parquet(str(tmp_path / "in"))
    features_stream(stream, False, O.node(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.value for r in spark.read.parquet(str(tmp_path / "out")).filter("col = 0").collect()} == {10.0}
    rows = spark.createDataFrame([("2026-01-01 00:00:01", "a"), ("2026-01-01 00:00:09", "a"), ("2026-01-01 00:01:00", "b")], "ts string, label string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.label, r.n) for r in label_windows(rows, "ts", "label", "30 seconds", "1 minute").collect()) == [("a", 2), ("b", 1)]


def test_streams_of_graphs_are_deduplicated(spark, tmp_path):
    """Two micro-batches with repeats, a restart from the checkpoint with a third, what is carried along, hashes seen before, and hashes that are forgotten."""
    from graphloom.streaming import unique_graphs

    def graphs(name, rows):
        out = None
        for k, (graph_id, labels, edges, at) in enumerate(rows):
            own = collection(spark, labels, edges, graph_id=graph_id).base.withColumn("at", F.lit(at).cast("timestamp")).withColumn("file", F.lit(f"{name}{k}"))
            out = own if out is None else out.unionByName(own)
        out.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return out

    triangle, relabelled, line = ("aab", [(0, 1), (1, 2), (0, 2)]), ("baa", [(0, 1), (1, 2), (0, 2)]), ("aab", [(0, 1), (1, 2)])
    first = graphs("f", [(1, *triangle, "2026-01-01 00:00:00"), (2, *line, "2026-01-01 00:00:01")])

    def run(name, **how):
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = unique_graphs(stream, False, **how)
        out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.graph_id, r.file) for r in spark.read.parquet(str(tmp_path / name)).collect())

    graphs("g", [(3, *relabelled, "2026-01-01 00:00:02"), (4, "abc", [(0, 1)], "2026-01-01 00:00:03")])
    kinds = {1: "triangle", 3: "triangle", 2: "line", 4: "other"}
    found = run("out")
    assert sorted(kinds[g] for g, _ in found) == ["line", "other", "triangle"] and all(f[0] in "fg" for _, f in found)
    graphs("h", [(5, *triangle, "2026-01-02 00:00:00"), (6, "z", [], "2026-01-02 00:00:01")])
    assert run("out") == sorted([*found, (6, "h1")])
    known = L.GraphHashDeduper().fit(collection(spark, *line)).index
    assert not {2} & {g for g, _ in run("fresh", known=known)}
    for k, day in enumerate((5, 8, 11)):
        graphs(f"i{k}", [(7 + 2 * k, *triangle, f"2026-01-{day:02} 00:00:00")])
    assert sum(g % 2 for g, _ in run("late", time="at", keep="1 hour")) >= 2  # the triangle came back days later


def test_distinct_subgraphs_are_not_deduplicated_again(spark):
    """Where node sets are known to be distinct a stage's deduplication is no work; where they may not be, it is."""
    ag = collection(spark, "xxxx", [(0, 1), (1, 2), (2, 3), (0, 2)])
    assert O.node()(ag).distinct and O.forward_compose(O.clique((1, 3)), O.filter_by_number_of_nodes((2, 3)))(ag).distinct and not O.neighborhood(1)(ag).distinct
    twice = O.add(O.edge(), O.edge())(ag)
    assert not twice.distinct and not O.node()(twice).distinct and O.deduplicate()(twice).distinct
    assert len(sets(O.deduplicate()(O.node()(twice)))) == 4 and len(sets(O.forward_compose(O.edge(), O.node())(ag))) == 4
    assert not O.edge()(collection(spark, "xy", [(0, 1), (1, 0)], True)).distinct


def test_halving():
    """Few edges are cut, the halves are equal, and what is said to be cut is cut; small graphs against all halvings."""
    import random

    count = lambda g, a: sum((u in a) != (v in a) for u, v in g.edges)
    ring = K.Graph(range(200), [(i, (i + 1) % 200) for i in range(200)], False)
    grid = K.Graph(range(400), [(20 * r + c, 20 * r + c + 1) for r in range(20) for c in range(19)] + [(20 * r + c, 20 * r + 20 + c) for r in range(19) for c in range(20)], False)
    for g, most in ((ring, 2), (grid, 24)):
        a, b = K.bisect(g, 0)
        assert len(a) == len(b) and count(g, a) <= most
    rng, over = random.Random(3), 0
    for _ in range(40):
        n = rng.randint(2, 9)
        g = K.Graph(range(n), [e for e in combinations(range(n), 2) if rng.random() < 0.4], False)
        cut, a, b = min(K.bisections(g, 1, 3), key=lambda x: x[0])
        assert cut == count(g, a) and a | b == set(range(n)) and not a & b and abs(len(a) - len(b)) <= 1
        over += cut - min(count(g, set(c)) for c in combinations(range(n), n // 2))
    assert over <= 3


def test_mean_distances_and_medoids(spark, monkeypatch):
    """Against plain loops, groups in one block and in many; one row by itself, repeated vectors."""
    from graphloom.functions import analysis as A

    rows = [(i, [float(i % 7), float(i * i % 5)], i % 3, i % 4) for i in range(40)] + [(99, [1.0, 1.0], 7, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, score int, grp int").withColumn("grp", F.when(F.col("id") == 99, 50).otherwise(F.col("grp")))
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    group = {i: 50 if i == 99 else g for i, _, _, g in rows}
    expected = {i: sum(far(v, w) for j, w, _, _ in rows if group[j] == group[i]) / max(1, sum(group[j] == group[i] for j in group) - 1) for i, v, _, _ in rows}
    for block in (4_096, 3):
        monkeypatch.setattr(A, "BLOCK", block)
        assert {r.id: r.distance for r in A.mean_distances(df, "id", "v", "grp").collect()} == pytest.approx(expected)
    score = {i: s for i, _, s, _ in rows}
    front = {i for i in group if not any(group[j] == group[i] and score[j] >= score[i] and expected[j] <= expected[i] + 1e-12 and (score[j] > score[i] or expected[j] < expected[i] - 1e-12) for j in group)}
    assert {r.id for r in A.medoids(df, "id", "v", "score", cluster_col="grp").collect()} == front
    assert A.medoids(df, "id", "v", "score", 2).count() > 0


def test_over_base_nodes_and_labels(kite):
    linked = O.forward_compose(O.edge(), O.intersection_edges())(kite)
    of = {r.sg_id: tuple(r.nodes) for r in linked.sg.collect()}
    assert sorted((r.node_id, *sorted((of[r.u], of[r.v]))) for r in L.inverse_links(linked).collect()) == sorted((n, *sorted((a, b))) for a, b in combinations(EDGES, 2) for n in {*a} & {*b})
    with pytest.raises(ValueError):
        L.inverse_links(kite)
    both = L.source_function_hash(O.add(O.edge(), O.edge(), O.node())(kite), 14)
    each = L.by_label(both).collect()
    assert sorted(r["rank"] for r in each if len(r.nodes) == 2) == list(range(1, 2 * len(EDGES) + 1)) and len(each) == 2 * len(EDGES) + len(NODES)
    assert L.by_label(both, unique=True).count() == len(EDGES) + len(NODES)


def test_combinations_of_sets(kite):
    """Undirected ones, by joins, against all choices; sets that are far apart, and in no common component, don't combine."""
    pairs = plain.subsets(1)
    for low, high in ((2, 3),):
        expected = {tuple(sorted(a + b)) for a, b in combinations(pairs, 2) if low <= plain.far[a[0], b[0]] <= high}
        three = {tuple(sorted(a + b + c)) for a, b, c in combinations(pairs, 3) if all(low <= plain.far[x[0], y[0]] <= high for x, y in combinations((a, b, c), 2))}
        assert sets(O.forward_compose(O.node(), O.combination((2, 3), (low, high)))(kite)) == sorted(expected | three)
    rings = O.compose_product(O.binary_combination((1, 1)), O.cycle(), O.edge())(kite)
    apart = [(r, e) for r in ((0, 1, 2), (3, 4, 5, 6)) for e in EDGES if min(plain.far[u, v] for u in r for v in e) == 1]
    assert sorted(set(sets(rings))) == sorted({tuple(sorted({*r, *e})) for r, e in apart})


def test_partition_parameters():
    """Two squares joined by one edge, and a long circle."""
    two = K.Graph(range(8), [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (5, 6), (6, 7), (4, 7), (3, 4)], False)
    given = {"max_part_size": 4, "min_overlap_nodes": 0, "low_attachment_min_component_size": 3}
    defaults = {**dict(O.REGISTRY["low_cut_partition"].defaults), **given}
    assert K.low_cut(two, defaults) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    ring = K.Graph(range(12), [(i, (i + 1) % 12) for i in range(12)], False)
    plain = {**defaults, "prefer_low_attachment_split": False}
    whole = [list(range(12))]
    assert len(K.low_cut(ring, plain)) > 1
    assert K.low_cut(ring, {**plain, "target_max_cut_edges": 1, "force_split_oversized": False}) == whole
    assert K.low_cut(ring, {**plain, "target_max_boundary_nodes": 1, "force_split_oversized": False}) == whole
    assert K.low_cut(ring, {**plain, "max_depth": 0}) == whole
    covered = K.low_cut(ring, {**plain, "strict_max_boundary": True, "target_max_boundary_nodes": 1})
    assert sorted(map(tuple, covered)) == sorted((min(u, v), max(u, v)) for u, v in ring.edges if any({u, v} <= set(c) for c in K.low_cut(ring, {**plain, "target_max_boundary_nodes": 1})))


def test_kernels_hold_nothing():
    """Results come one by one: the first few of a graph of a great many."""
    from itertools import islice

    n = 40
    full = K.Graph(range(n), [(i, j) for i in range(n) for j in range(i + 1, n)], False)
    assert len(list(islice(K.cliques(full, 3, 20), 500))) == 500 and len(list(islice(K.connected_subsets(full, 20), 500))) == 500
    arcs = K.Graph(range(n), [(i, j) for i in range(n) for j in range(n) if i != j], True)
    assert len(list(islice(K.cycles(arcs), 500))) == 500
    small = K.Graph(range(6), [(0, 1), (1, 2), (2, 3), (3, 0), (1, 4), (4, 5)], False)
    sets_ = list(K.connected_subsets(small, 4))
    assert sorted(map(sorted, sets_)) == sorted(list(c) for k in range(1, 5) for c in combinations(range(6), k) if len(K.components(small.part(c))) == 1)


def test_ml_stages(spark, kite):
    from graphloom.plans.programs import to_xml

    stage = L.GraphFeatures(to_xml(O.edge()), nbits=8)
    row = stage.transform(kite.base).collect()[0]
    assert row.features.size == 256 and row.features[0] == len(NODES) and row.features[1] == 2 * len(EDGES) and row.graph_id == 1
    nodes = L.NodeFeatures(O.node(), nbits=8).transform(kite.base).collect()
    assert {r.node_id: r.features[1] for r in nodes} == {n: sum(n in e for e in EDGES) for n in NODES}


def test_tokens_and_parsers(spark):
    from graphloom.sources import views as V

    texts = spark.createDataFrame([(1, "The cat sat"), (2, None), (3, "one")], "doc_id long, text string")
    rows = V.parsed_tokens(texts).orderBy("graph_id", "node_id").collect()
    assert [(r.text, r.char_start, r.char_end, r.head) for r in rows if r.graph_id == 1] == [("The", 0, 3, None), ("cat", 4, 7, 0), ("sat", 8, 11, 1)]
    star = lambda text: [{"text": w, "pos": "VERB" if i == 2 else "X", "dep": "root" if i == 2 else "nsubj", "head": None if i == 2 else 2} for i, w in enumerate(text.split())]
    ag = V.dependency_graphs(V.parsed_tokens(texts.filter("doc_id = 1"), star, label="pos"))
    base = ag.base.collect()[0]
    assert ag.directed and {(e.src, e.dst) for e in base.edges} == {(2, 0), (2, 1)} and [n.labels for n in base.nodes] == [["X"], ["X"], ["VERB"]]


def test_analysis(spark):
    from graphloom.functions import analysis as A
    from graphloom.sources.generators import random_graphs

    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.1 * (i % 2)], i % 3) for i in range(12)], "id long, v array<double>, score int")
    flat = {r.id: r.x for r in A.plane(rows, "id", "v").collect()}
    assert abs(abs(flat[11] - flat[0]) - 11 * 5**0.5) < 0.1
    assert {r.id for r in A.medoids(rows, "id", "v", "score", 2).collect()} <= set(range(12))
    points = spark.createDataFrame([("a", 3, 1.0), ("a", 2, 1.05), ("a", 1, 2.0)], "g string, x int, y double")
    assert sorted(r.x for r in A.pareto_front(points, "g", "x", "y", 1, 0.1).collect()) == [2, 3] and [r.x for r in A.pareto_front(points, "g", "x", "y").collect()] == [3]
    g = random_graphs(spark, 2, "regular", instance_size=10).base.collect()
    assert [sorted(sum(n.id in (e.src, e.dst) for e in r.edges) for n in r.nodes) for r in g] == [[3] * 10] * 2 and g[0].edges != g[1].edges
