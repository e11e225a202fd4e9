"""Decompositions of each mapped subgraph: native where they are expressions, Arrow kernels where they aren't.

A kernel gets a subgraph's adjacency once and hands back lists of nodes; their induced edges are looked up in the
adjacency of the base graph, which travels with the few rows that go in and not with the many that come out.
"""

from __future__ import annotations

from array import array
from dataclasses import replace
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import EDGE_SET, AGFrame, edge_induced, following, meta_of, pairs, ready, set_key
from .registry import operator, span

#: Components that a kernel hands back at once.
FLUSH = 8_192
PARTS = f"graph_id bigint, ord bigint, parent bigint, nodes array<bigint>, edges {EDGE_SET}"


def _lists(column) -> list[list[int]]:
    return column.to_pylist()


def _arcs(column) -> list[list[tuple[int, int]]]:
    """The edge lists of a column, without a dictionary for each edge."""
    flat, offsets = column.flatten(), column.offsets.to_pylist()
    every = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True))
    return [every[a - offsets[0]:b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _checked(found, streams: bool = False):
    """What a decomposition gives: a list; the kernels here may give their results one by one, so that none has to hold them all."""
    if streams:
        return found
    if not isinstance(found, list):
        raise TypeError(f"a decomposition gives a list of components, not {type(found).__name__}")
    return found


class _Out:
    """Rows of PARTS, gathered column by column."""

    def __init__(self):
        self.heads, self.nodes, self.src, self.dst, self.n_at, self.e_at = [], [], [], [], [0], [0]

    def add(self, head, nodes, edges) -> None:
        self.heads.append(head)
        self.nodes += nodes
        self.src += [u for u, _ in edges]
        self.dst += [v for _, v in edges]
        self.n_at.append(len(self.nodes))
        self.e_at.append(len(self.src))

    def full(self) -> bool:
        return len(self.heads) >= FLUSH

    def batch(self):
        import pyarrow as pa

        arcs = pa.StructArray.from_arrays([pa.array(self.src, pa.int64()), pa.array(self.dst, pa.int64())], ["src", "dst"])
        out = [pa.array([h[i] for h in self.heads], pa.int64()) for i in range(3)]
        out += [pa.ListArray.from_arrays(pa.array(self.n_at, pa.int32()), pa.array(self.nodes, pa.int64())), pa.ListArray.from_arrays(pa.array(self.e_at, pa.int32()), arcs)]
        self.__init__()
        return pa.RecordBatch.from_arrays(out, ["graph_id", "ord", "parent", "nodes", "edges"])


def _among(nodes: list[int], ahead: dict[int, list[int]]) -> list[tuple[int, int]]:
    """The edges between these nodes, which are in order."""
    if len(nodes) < 2:
        return []
    inside = set(nodes)
    return [(u, v) for u in nodes for v in ahead.get(u, ()) if v in inside]


def _ahead(arcs: list[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for u, v in sorted(arcs):
        out.setdefault(u, []).append(v)
    return out


def _going_in(ag: AGFrame) -> DataFrame:
    """The subgraphs with their key and the base graph's edges (null where these are their own)."""
    rows = ag.sg.select("graph_id", "ord", set_key().alias("parent"), "nodes", "edges")
    if ag.untouched:
        return rows.withColumn("arcs", F.lit(None).cast(EDGE_SET))
    return rows.join(ag.base.select("graph_id", pairs(F.col("edges")).alias("arcs")), "graph_id")


def local_parts(ag: AGFrame, fn, streams: bool = False, once: bool = False) -> DataFrame:
    """graph_id, ord, parent, nodes, edges: one row per list of nodes that ``fn(Graph)`` gives for a subgraph, with the edges of the base graph.

    One pass over the rows. Node lists are made distinct and put in order. ``once``: of equal lists of a subgraph the first, known by 128 bits.
    """
    directed = ag.directed

    def run(batches):
        out = _Out()
        for batch in batches:
            arcs_of = batch.column("arcs")
            columns = [batch.column(c).to_pylist() for c in ("graph_id", "ord", "parent")]
            given, held = _arcs(arcs_of) if arcs_of.null_count == 0 else None, (None, {})
            for i, (nodes, edges) in enumerate(zip(_lists(batch.column("nodes")), _arcs(batch.column("edges")), strict=True)):
                graph_id, order, parent = (c[i] for c in columns)
                found, seen = _checked(fn(K.Graph(nodes, edges, directed)), streams), set()
                if given is None:
                    ahead = _ahead(edges)
                else:
                    held = held if held[0] == graph_id else (graph_id, _ahead(given[i]))
                    ahead = held[1]
                for part in found:
                    own = sorted(set(part))
                    if once:
                        key = blake2b(array("q", own).tobytes(), digest_size=16).digest()
                        if key in seen:
                            continue
                        seen.add(key)
                    out.add((graph_id, order, parent), own, _among(own, ahead))
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return _going_in(ag).mapInArrow(run, PARTS)


def local_nodes(ag: AGFrame, fn, name: str, params: dict | None = None, skip_empty: bool = False, streams: bool = False, once: bool = False) -> AGFrame:
    """Custom operator: ``fn(Graph) -> list of node lists`` for each subgraph; each becomes a node-induced subgraph."""
    rows = local_parts(ag, fn, streams, once).withColumn("meta", meta_of(name, params or {}, ag.chain, F.col("parent")))
    out = ready(ag, rows.filter(F.size("nodes") > 0) if skip_empty else rows)
    return following(ag, out) if ag.untouched else out


def _edge_rows(found, directed: bool, head, out: _Out) -> None:
    for part in _checked(found):
        arcs = list(dict.fromkeys((u, v) if directed else (min(u, v), max(u, v)) for u, v in part))
        out.add(head, [], arcs)


def local_edges(ag: AGFrame, fn, name: str, params: dict | None = None, skip_empty: bool = False) -> AGFrame:
    """Custom operator: ``fn(Graph) -> list of edge lists``; each becomes an edge-induced subgraph."""
    directed = ag.directed

    def run(batches):
        out = _Out()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("graph_id", "ord", "parent")]
            for i, (nodes, edges) in enumerate(zip(_lists(batch.column("nodes")), _arcs(batch.column("edges")), strict=True)):
                _edge_rows(fn(K.Graph(nodes, edges, directed)), directed, tuple(c[i] for c in columns), out)
                if out.full():
                    yield out.batch()
        yield out.batch()

    rows = ag.sg.select("graph_id", "ord", set_key().alias("parent"), "nodes", "edges").mapInArrow(run, PARTS)
    rows = rows.withColumn("meta", meta_of(name, params or {}, ag.chain, F.col("parent"))).select("graph_id", "edges", "ord", "meta")
    return edge_induced(ag, rows.filter(F.size("edges") > 0) if skip_empty else rows)


def _all_of_each(ag: AGFrame, with_edges: bool) -> DataFrame:
    """graph_id, ids, arcs (of the base graph), sets and set_edges (of all subgraphs in order): one row a graph."""
    item = [F.col("ord"), F.size("nodes").alias("size"), F.col("nodes"), *([F.col("edges")] if with_edges else [])]
    per_graph = ag.sg.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(*item))).alias("all"))
    rows = ag.base.select("graph_id", F.transform("nodes", lambda x: x["id"]).alias("ids"), pairs(F.col("edges")).alias("arcs")).join(per_graph, "graph_id")
    more = [F.transform("all", lambda x: x["edges"]).alias("set_edges")] if with_edges else []
    return rows.select("graph_id", "ids", "arcs", F.transform("all", lambda x: x["nodes"]).alias("sets"), *more)


def global_nodes(ag: AGFrame, fn, name: str, params: dict | None = None, skip_empty: bool = False, streams: bool = False) -> AGFrame:
    """Custom operator: ``fn(list of node lists, Graph of the base) -> node lists`` over all subgraphs of a graph; no parent is recorded."""
    directed = ag.directed

    def run(batches):
        out = _Out()
        for batch in batches:
            for graph_id, ids, arcs, sets in zip(batch.column("graph_id").to_pylist(), _lists(batch.column("ids")), _arcs(batch.column("arcs")), _lists(batch.column("sets")), strict=True):
                ahead = _ahead(arcs)
                for part in _checked(fn(sets, K.Graph(ids, arcs, directed)), streams):
                    own = sorted(set(part))
                    out.add((graph_id, 0, 0), own, _among(own, ahead))
                    if out.full():
                        yield out.batch()
        yield out.batch()

    rows = _all_of_each(ag, False).mapInArrow(run, PARTS).withColumn("meta", meta_of(name, params or {}, ag.chain, False))
    return ready(ag, rows.filter(F.size("nodes") > 0) if skip_empty else rows)


def global_edges(ag: AGFrame, fn, name: str, params: dict | None = None, skip_empty: bool = False) -> AGFrame:
    """Custom operator: ``fn(list of Graphs, Graph of the base) -> edge lists`` over all subgraphs of a graph; no parent is recorded."""
    directed = ag.directed

    def run(batches):
        out = _Out()
        for batch in batches:
            for graph_id, ids, arcs, sets, edges in zip(batch.column("graph_id").to_pylist(), _lists(batch.column("ids")), _arcs(batch.column("arcs")), _lists(batch.column("sets")), batch.column("set_edges").to_pylist(), strict=True):
                graphs = [K.Graph(n, [(x["src"], x["dst"]) for x in e], directed) for n, e in zip(sets, edges, strict=True)]
                _edge_rows(fn(graphs, K.Graph(ids, arcs, directed)), directed, (graph_id, 0, 0), out)
                if out.full():
                    yield out.batch()
        yield out.batch()

    rows = _all_of_each(ag, True).mapInArrow(run, PARTS).withColumn("meta", meta_of(name, params or {}, ag.chain, False))
    rows = rows.select("graph_id", "edges", "ord", "meta")
    return edge_induced(ag, rows.filter(F.size("edges") > 0) if skip_empty else rows)


@operator("identity", "preserve")
def identity(ag: AGFrame) -> AGFrame:
    """Everything as it is."""
    return ag


@operator("node", "preserve")
def node(ag: AGFrame) -> AGFrame:
    """One subgraph for each node."""
    rows = ag.sg.withColumn("meta", meta_of("node", {}, ag.chain)).withColumn("n", F.explode("nodes"))
    out = rows.select("graph_id", F.lit(0).cast("long").alias("sg_id"), F.array("n").alias("nodes"), F.array().cast(EDGE_SET).alias("edges"), F.lit(ag.version).alias("version"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<double>").alias("attribute"), "ord", "meta")
    return following(ag, ag.with_sg(out, induced=True))


@operator("edge", "preserve")
def edge(ag: AGFrame) -> AGFrame:
    """One subgraph of two nodes for each edge, with all base edges between them."""
    if ag.directed:
        return local_nodes(ag, lambda g: [list(e) for e in g.edges], "edge")
    rows = ag.sg.withColumn("meta", meta_of("edge", {}, ag.chain)).withColumn("e", F.explode("edges"))
    out = rows.select("graph_id", F.lit(0).cast("long").alias("sg_id"), F.array_sort(F.array("e.src", "e.dst")).alias("nodes"), F.array("e").alias("edges"), F.lit(ag.version).alias("version"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<double>").alias("attribute"), "ord", "meta")
    return following(ag, ag.with_sg(out, induced=True))


def _kernel(name: str, support: str, fn, doc: str, few: bool = False, **defaults):
    """An operator that is one kernel on each subgraph; ``fn(Graph, **params)``. ``few``: no more results than nodes, or some times as many."""

    def run(ag: AGFrame, **params) -> AGFrame:
        given = defaults | params
        made = lambda once: local_nodes(ag, lambda g: fn(g, **given), name, params, streams=True, once=once)
        out = made(False)
        return replace(out, once=(out.sg, made(True).sg, True)) if few and ag.untouched else out

    run.__doc__ = doc
    return operator(name, support, **defaults)(run)


degree = _kernel("degree", "preserve", lambda g, value: K.of_degree(g, *span(value)), "The nodes whose degree inside the subgraph is in range; one subgraph for each, even if empty.", value=(0, 2))
neighborhood = _kernel("neighborhood", "directed", lambda g, radius: K.neighborhood(g, *span(radius)), "For each node and radius in range the nodes within reach, inside the subgraph.", few=True, radius=(0, 1))
connected_component = _kernel("connected_component", "weak", lambda g: K.components(g), "Connected components; of digraphs the weak ones.")
cycle = _kernel("cycle", "directed", lambda g: K.cycles(g), "Undirected: a basis of the cycles; directed: all simple cycles.")
tree = _kernel("tree", "weak", lambda g: K.trees(g), "What is left without the edges on cycles, in components of two nodes or more.")
path = _kernel("path", "directed", lambda g, number_of_edges: K.geodesics(g, *span(number_of_edges)), "Distinct node sets of shortest paths whose length is in range.", number_of_edges=(1, 3))
spine = _kernel("spine", "weak", lambda g, radius, seed: K.spine(g, radius, seed), "A longest shortest path, widened by a radius.", radius=0, seed=42)
graphlet = _kernel("graphlet", "weak", lambda g, radius, number_of_nodes: K.graphlets(g, radius, *span(number_of_nodes)), "Connected node sets of a size in range that lie within a radius of some node.", radius=1, number_of_nodes=(1, 3))
clique = _kernel("clique", "undirected_only", lambda g, number_of_nodes: K.cliques(g, *span(number_of_nodes)), "All cliques of a size in range.", number_of_nodes=(1, 3))
betweenness_centrality = _kernel("betweenness_centrality", "directed", lambda g, number_of_nodes, use_perifery: K.central(g, number_of_nodes, use_perifery), "The most (or least) central nodes.", number_of_nodes=1, use_perifery=False)
betweenness_centrality_split = _kernel("betweenness_centrality_split", "weak", lambda g, number_of_nodes: K.central_runs(g, number_of_nodes), "Runs of nodes in order of centrality.", number_of_nodes=5)
betweenness_centrality_hop_split = _kernel("betweenness_centrality_hop_split", "weak", lambda g, n_hops: K.hop_windows(g, n_hops), "Components of overlapping windows of distance from central nodes.", n_hops=1)
union_of_shortest_paths = _kernel("union_of_shortest_paths", "weak", lambda g, length: K.shortest_path_unions(g, *span(length)), "For each pair of nodes at a distance in range all nodes on their shortest paths.", length=(1, 3))
random_part = _kernel("random_part", "preserve", lambda g, n_samples, seed: K.random_parts(g, int(n_samples), seed), "Largest component of a seeded bootstrap draw of nodes.", n_samples=1, seed=0)
split = _kernel("split", "weak", lambda g, n_parts, seed: K.split(g, n_parts, seed), "At least so many connected parts by repeated halving.", n_parts=2, seed=0)
#: The defaults of the partitioner's sixteen parameters.
LOW_CUT = {
    "target_max_boundary_nodes": 2, "target_max_cut_edges": 2, "max_part_size": 24, "min_part_size": 3, "max_split_trials": 8,
    "balance_tolerance": 0.2, "max_depth": 6, "force_split_oversized": True, "allow_small_parts": False, "min_overlap_nodes": 1,
    "strict_max_boundary": False, "prefer_low_attachment_split": True, "low_attachment_max_edges": 2,
    "low_attachment_min_component_size": 6, "low_attachment_max_pair_trials": 3000, "seed": None,
}
low_cut_partition = _kernel("low_cut_partition", "undirected_only", lambda g, **p: K.low_cut(g, p), "Parts of bounded size between which few edges are cut.", **LOW_CUT)

