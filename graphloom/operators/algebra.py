"""Composition, control flow and set algebra over subgraphs, all native but the two distance operators."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import replace
from itertools import chain, combinations, groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import large
from ..functions import kernels as K
from ..large import met
from ..model import EDGE_SET, SG_COLUMNS, AGFrame, cut, edge_induced, induced, meta_of, null_of, pairs, renumbered, set_key, whole
from .registry import operator, span
from .structure import global_nodes


def n_components(nodes: str, edges: str):
    """Column: number of components of a subgraph, direction ignored."""

    @arrow_udf("int")
    def count(n, e):
        import pyarrow as pa

        return pa.array([len(K.components(K.Graph(ns, [(x["src"], x["dst"]) for x in es], False))) for ns, es in zip(n.to_pylist(), e.to_pylist(), strict=True)], pa.int32())

    return count(nodes, edges)


# ---- composition -------------------------------------------------------------------------------


def _first_of(sg: DataFrame) -> DataFrame:
    rest = [c for c in SG_COLUMNS if c not in ("graph_id", "nodes")]
    first = sg.groupBy("graph_id", "nodes").agg(F.min_by(F.struct(*rest), F.struct("ord", "sg_id", "edges")).alias("x"))
    return first.select("graph_id", "nodes", *[F.col(f"x.{c}").alias(c) for c in rest])


@operator("deduplicate", "preserve")
def deduplicate(ag: AGFrame) -> AGFrame:
    """The first subgraph of each node set, with its meta; links among those that stay are kept."""
    if ag.distinct:
        return ag
    if ag.links is None and ag.once is not None and ag.once[0] is ag.sg and ag.once[2]:
        return replace(ag, sg=ag.once[1], together=ag.once[1], distinct=True)
    kept = _first_of(ag.once[1] if ag.once is not None and ag.once[0] is ag.sg and ag.links is None else ag.sg)
    if ag.links is None:
        return replace(ag.with_sg(kept), distinct=True)
    ids = kept.select("graph_id", F.col("sg_id").alias("id"))
    links = ag.links.join(ids.withColumnRenamed("id", "u"), ["graph_id", "u"], "left_semi").join(ids.withColumnRenamed("id", "v"), ["graph_id", "v"], "left_semi")
    return replace(ag.with_sg(kept, links), distinct=True)


def _dedup(ag: AGFrame, dedup: bool) -> AGFrame:
    return deduplicate()(ag) if dedup else ag


def _same_base(results: list[AGFrame], ag: AGFrame) -> bool:
    return all(r.base is ag.base for r in results)


@operator("add", "agnostic", "control", dedup=True)
def add(ag: AGFrame, children, dedup: bool = True) -> AGFrame:
    """All children's subgraphs of the same input, those of earlier children first; each child's are deduplicated.

    Subgraphs that an operator made are written once, and not worked out again for each child.
    """
    if len(children) > 1 and not ag.untouched:
        ag = replace(ag, sg=cut(ag.sg))
    results = [_dedup(c(ag), dedup) for c in children]
    if _same_base(results, ag):  # one union, one numbering
        sg = None
        for i, r in enumerate(results):
            own = r.sg.withColumn("ord", F.lit(i).cast("long"))
            sg = own if sg is None else sg.unionByName(own)
        parents = tuple(dict.fromkeys(p for r in results for p in r.parents))
        return replace(ag.with_sg(sg), version=max(r.version for r in results), parents=parents, induced=all(r.induced for r in results))
    total = results[0]
    for r in results[1:]:
        total = total + r
    return total


@operator("forward_compose", "agnostic", "control", dedup=True)
def forward_compose(ag: AGFrame, children, dedup: bool = True) -> AGFrame:
    """One after the other, from left to right."""
    for c in children:
        ag = _dedup(c(ag), dedup)
    return ag


@operator("compose", "agnostic", "control", dedup=True)
def compose(ag: AGFrame, children, dedup: bool = True) -> AGFrame:
    """One after the other, from right to left."""
    for c in reversed(children):
        ag = _dedup(c(ag), dedup)
    return ag


@operator("compose_product", "agnostic", "control", dedup=True)
def compose_product(ag: AGFrame, children, dedup: bool = True) -> AGFrame:
    """The first argument combines what the others make of the same input."""
    combiner, *rest = children
    return combiner(*[_dedup(c(ag), dedup) for c in rest])


def _holds(ag: AGFrame, predicate) -> DataFrame:
    """graph_id, yes: a predicate gives a boolean Column over a frame of one row per graph, or such a frame itself."""
    found = predicate(ag)
    return found.select("graph_id", F.coalesce(F.col(found.columns[-1]).cast("boolean"), F.lit(False)).alias("yes"))


def _only(ag: AGFrame, which: DataFrame) -> AGFrame:
    return replace(ag, base=ag.base.join(which, "graph_id", "left_semi"), sg=ag.sg.join(which, "graph_id", "left_semi"), links=None if ag.links is None else ag.links.join(which, "graph_id", "left_semi"))


def _gathered(parts: list[AGFrame], ag: AGFrame) -> AGFrame:
    base, sg = parts[0].base, parts[0].sg
    for p in parts[1:]:
        base, sg = base.unionByName(p.base), sg.unionByName(p.sg)
    parents = tuple(dict.fromkeys(x for p in parts for x in p.parents))
    return replace(ag, base=base, sg=sg, links=None, version=max(p.version for p in parts), parents=parents, induced=all(p.induced for p in parts), untouched=False, distinct=all(p.distinct for p in parts), most=None)


@operator("if_then_elif_else", "agnostic", "control")
def if_then_elif_else(ag: AGFrame, children) -> AGFrame:
    """Each graph goes the way of the first predicate that holds for it; arguments: pairs (predicate, operator), then the last operator.

    Base graphs are written once for the predicates and once with the way they go, so that no way works them out again.
    """
    *cases, last = children
    plain = ag.untouched and ag.together is ag.sg and ag.version == 0  # the subgraphs are the base graphs, just as they are
    of = lambda base, sg: replace(ag, base=base, sg=sg, together=sg if plain else None)
    made = lambda base: whole(base, ag.directed).sg
    base = cut(ag.base)
    left = of(base, made(base) if plain else cut(ag.sg))
    tables, ways = (left.base, left.sg), None
    for i, (predicate, _) in enumerate(cases):
        found = cut(_holds(left, predicate))
        way = found.filter("yes").select("graph_id", F.lit(i).alias("_way"))
        ways = way if ways is None else ways.unionByName(way)
        left = _only(left, found.filter("NOT yes"))
    ways = ways.unionByName(found.filter("NOT yes").select("graph_id", F.lit(len(cases)).alias("_way")))
    base, sg = (cut(t.join(ways, "graph_id")) if i == 0 or not plain else None for i, t in enumerate(tables))
    parts = []
    for i, then in enumerate([*(then for _, then in cases), last]):
        own = base.filter(F.col("_way") == i).drop("_way")
        part = of(own, made(own) if plain else sg.filter(F.col("_way") == i).drop("_way"))
        parts.append(then(part if ag.links is None else replace(part, links=ag.links.join(ways.filter(F.col("_way") == i), "graph_id", "left_semi"))))
    return _gathered(parts, ag)


@operator("if_then_else", "agnostic", "control")
def if_then_else(ag: AGFrame, children) -> AGFrame:
    """predicate, operator where it holds, operator where it doesn't; decided for each graph."""
    predicate, then, other = children
    return if_then_elif_else((predicate, then), other)(ag)


@operator("for_loop", "agnostic", "control", n_iterations=1)
def for_loop(ag: AGFrame, children, n_iterations: int = 1) -> AGFrame:
    """The operator so many times."""
    for _ in range(n_iterations):
        ag = children[0](ag)
    return ag


def _written(ag: AGFrame) -> AGFrame:
    """The collection with its lineage cut, in the folder that all executors share."""
    return replace(ag, sg=cut(ag.sg), base=cut(ag.base))


@operator("while_loop", "agnostic", "control", max_iterations=100)
def while_loop(ag: AGFrame, children, max_iterations: int = 100) -> AGFrame:
    """operator, predicate: repeated for each graph as long as the predicate holds for it; finished graphs are set aside."""
    body, predicate = children
    done, left = [], ag
    for i in range(max_iterations):
        yes = _holds(left, predicate)
        done.append(_only(left, yes.filter("NOT yes")))
        left = _written(_only(left, yes.filter("yes")))
        if left.base.isEmpty():
            return _gathered([*done, left], ag)
        left = _written(body(left)) if i % 4 == 3 else body(left)
    return _gathered([*done, left], ag)


# ---- complements and unions --------------------------------------------------------------------


def _with_base(ag: AGFrame) -> DataFrame:
    of = ag.base.select("graph_id", F.transform("nodes", lambda x: x["id"]).alias("_ids"), pairs(F.col("edges")).alias("_arcs"))
    return ag.sg.join(of, "graph_id")


@operator("complement", "preserve")
def complement(ag: AGFrame) -> AGFrame:
    """The base graph's other nodes, even if there are none."""
    rows = _with_base(ag).withColumn("meta", meta_of("complement", {}, ag.chain))
    return induced(ag, rows.select("graph_id", F.array_except("_ids", "nodes").alias("nodes"), "ord", "meta"))


@operator("edge_complement", "preserve")
def edge_complement(ag: AGFrame) -> AGFrame:
    """The base graph's other edges, even if there are none."""
    rows = _with_base(ag).withColumn("meta", meta_of("edge_complement", {}, ag.chain))
    return edge_induced(ag, rows.select("graph_id", F.array_except("_arcs", "edges").alias("edges"), "ord", "meta"))


def _by_parent(ag: AGFrame) -> DataFrame:
    """graph_id, p_nodes, p_edges, all_nodes, all_edges, ord: each parent's sets, and those of its children together."""
    every = None
    for sg in dict.fromkeys((*ag.parents, ag.sg)):
        own = sg.select("graph_id", set_key().alias("parent"), F.col("nodes").alias("p_nodes"), F.col("edges").alias("p_edges"))
        every = own if every is None else every.unionByName(own)
    rows = ag.sg.select("graph_id", F.coalesce("meta.parent", set_key()).alias("parent"), "nodes", "edges", "ord")
    children = rows.groupBy("graph_id", "parent").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("all_nodes"), F.array_distinct(F.flatten(F.collect_list("edges"))).alias("all_edges"), F.min("ord").alias("ord"))
    return children.join(every.dropDuplicates(["graph_id", "parent"]), ["graph_id", "parent"])


@operator("local_complement", "weak")
def local_complement(ag: AGFrame) -> AGFrame:
    """For each parent its nodes in none of its children, with the parent's edges among them; none if all are covered."""
    rows = _by_parent(ag).withColumn("left", F.array_sort(F.array_except("p_nodes", "all_nodes"))).filter(F.size("left") > 0)
    inside = F.filter("p_edges", lambda e: F.array_contains(F.col("left"), e["src"]) & F.array_contains(F.col("left"), e["dst"]))
    rows = rows.withColumn("meta", meta_of("local_complement", {}, ag.chain, F.col("parent"))).select("graph_id", F.col("left").alias("nodes"), inside.alias("edges"), "ord", "meta")
    return ag.with_sg(_plain(rows, ag.version), induced=False)


@operator("local_edge_complement", "preserve")
def local_edge_complement(ag: AGFrame) -> AGFrame:
    """For each parent its edges in none of its children; none if all are covered."""
    rows = _by_parent(ag).withColumn("edges", F.sort_array(F.array_except("p_edges", "all_edges"))).filter(F.size("edges") > 0)
    rows = rows.withColumn("meta", meta_of("local_edge_complement", {}, ag.chain, F.col("parent")))
    return edge_induced(ag, rows.select("graph_id", "edges", "ord", "meta"))


def _plain(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("sg_id", F.lit(0).cast("long")).withColumn("version", F.lit(version)).withColumn("label", null_of("long")).withColumn("attribute", null_of("array<double>")).select(*SG_COLUMNS)


@operator("merge", "preserve", use_edges=False)
def merge(ag: AGFrame, use_edges: bool = False) -> AGFrame:
    """One subgraph of each graph: the union of all its subgraphs' nodes, or of their edges; empty if it has none."""
    both = ag.sg.groupBy("graph_id").agg(F.array_distinct(F.flatten(F.collect_set("nodes"))).alias("n"), F.array_distinct(F.flatten(F.collect_set("edges"))).alias("e"))
    rows = ag.base.select("graph_id").join(both, "graph_id", "left").withColumn("meta", meta_of("merge", {"use_edges": use_edges}, ag.chain, False))
    if use_edges:
        return edge_induced(ag, rows.select("graph_id", F.coalesce("e", F.array().cast(EDGE_SET)).alias("edges"), "meta"))
    return induced(ag, rows.select("graph_id", F.array_sort(F.coalesce("n", F.array().cast("array<bigint>"))).alias("nodes"), "meta"))


def _not_covered(ag: AGFrame) -> DataFrame:
    """The subgraphs of few nodes that lie in no larger one, where all are induced and of different nodes.

    Each hands its nodes to all its subsets, which most of a graph's subgraphs share: these are united before they are shuffled.
    """
    rest = [c for c in SG_COLUMNS if c not in ("graph_id", "nodes")]
    parts = F.expr("transform(sequence(0, shiftleft(1, size(nodes)) - 1), m -> struct(filter(nodes, (x, i) -> (shiftright(m, i) & 1) = 1) AS nodes, m = shiftleft(1, size(nodes)) - 1 AS own))")
    marks = ag.sg.withColumn("nodes", F.array_sort("nodes")).select("graph_id", *rest, F.explode(parts).alias("x")).select("graph_id", "x.nodes", "x.own", F.when(F.col("x.own"), F.struct(*rest)).alias("rest"))
    held = marks.groupBy("graph_id", "nodes").agg(F.max("own").alias("own"), F.min("own").alias("alone"), F.first("rest", ignorenulls=True).alias("rest"))
    return held.filter("own AND alone").select("graph_id", "nodes", *[F.col(f"rest.{c}").alias(c) for c in rest])


@operator("remove_redundant_mapped_subgraphs", "preserve")
def remove_redundant_mapped_subgraphs(ag: AGFrame) -> AGFrame:
    """Without the subgraphs whose nodes and edges all lie in another one that has more.

    Of induced subgraphs of few nodes whose graphs' rows follow one another, those in other ones are marked by all subsets, in these rows.
    """
    if ag.induced and ag.distinct and ag.links is None and ag.together is ag.sg and ag.most is not None and ag.most <= FEW_NODES and _beyond(ag.sg, ROW_SETS) is None:
        out = ag.with_sg(_left_over(ag.sg))
        return replace(out, together=out.sg)
    if ag.induced and ag.distinct and ag.links is None and (ag.most <= FEW_NODES if ag.most is not None else ag.sg.filter(F.size("nodes") > FEW_NODES).isEmpty()):
        return ag.with_sg(_not_covered(ag))
    sg = cut(renumbered(ag.sg) if ag.links is None else ag.sg)
    small = sg.select("graph_id", F.col("sg_id").alias("a"), F.col("nodes").alias("an"), F.col("edges").alias("ae"))
    large = sg.select("graph_id", F.col("sg_id").alias("b"), F.col("nodes").alias("bn"), F.col("edges").alias("be"), F.explode("nodes").alias("first"))
    within = (F.size(F.array_except("an", "bn")) == 0) & (F.size(F.array_except("ae", "be")) == 0) & ((F.size("an") < F.size("bn")) | (F.size("ae") < F.size("be")))
    covered = met(small.withColumn("first", F.get("an", F.lit(0))).filter(F.col("first").isNotNull()), large, ["graph_id", "first"]).filter((F.col("a") != F.col("b")) & within)
    empty = small.filter(F.size("an") == 0).join(sg.filter(F.size("nodes") > 0).select("graph_id").distinct(), "graph_id", "left_semi")
    gone = covered.select("graph_id", F.col("a").alias("sg_id")).unionByName(empty.select("graph_id", F.col("a").alias("sg_id")))
    kept = sg.join(gone, ["graph_id", "sg_id"], "left_anti")
    if ag.links is None:
        return ag.with_sg(kept)
    ids = kept.select("graph_id", F.col("sg_id").alias("id"))
    links = ag.links.join(ids.withColumnRenamed("id", "u"), ["graph_id", "u"], "left_semi").join(ids.withColumnRenamed("id", "v"), ["graph_id", "v"], "left_semi")
    return ag.with_sg(kept, links)


#: Members of a graph's subgraphs up to which covered ones are found in its rows.
ROW_SETS = 200_000


def _left_over(sg: DataFrame) -> DataFrame:
    """The subgraphs of few nodes, each graph's in a row, that lie in no larger one; Python keeps one graph's as Arrow rows and the node sets that are covered."""

    def run(batches):
        import pyarrow as pa

        held: list = []  # of one graph

        def left():
            sets = [sorted(x) for b in held for x in _lists_of(b.column("nodes"))]
            covered = {part for x in sets for k in range(len(x)) for part in combinations(x, k)}
            keep, at = [tuple(x) not in covered for x in sets], 0
            for b in held:
                own = b.filter(pa.array(keep[at:at + b.num_rows], pa.bool_()))
                at += b.num_rows
                if own.num_rows:
                    yield own

        for b in batches:
            ids, start = b.column("graph_id").to_pylist(), 0
            for graph_id, own in groupby(ids):
                size = sum(1 for _ in own)
                if held and held[-1].column("graph_id")[-1].as_py() != graph_id:
                    yield from left()
                    held.clear()
                held.append(b.slice(start, size))
                start += size
        yield from left()

    return sg.mapInArrow(run, sg.schema)


#: Nodes of a subgraph up to which its common nodes with others are found from its subsets, without making pairs.
FEW_NODES = 4


def _sets(ag: AGFrame) -> DataFrame:
    """graph_id, sg_id, nodes (in order), written once; ids are only different ones."""
    return cut(ag.sg.select("graph_id", F.monotonically_increasing_id().alias("sg_id"), F.array_sort(F.array_distinct("nodes")).alias("nodes")))


def _subsets(nodes: str):
    return F.explode(F.expr(f"transform(sequence(1, shiftleft(1, size({nodes})) - 1), m -> filter({nodes}, (x, i) -> (shiftright(m, i) & 1) = 1))"))


def _holding(sets: DataFrame, name: str) -> DataFrame:
    """graph_id, nodes and how many of the sets hold these, for all subsets of sets of few nodes."""
    return sets.filter(F.size("nodes") > 0).select("graph_id", _subsets("nodes").alias("nodes")).groupBy("graph_id", "nodes").agg(F.count("*").alias(name))


def _exactly(held: DataFrame) -> DataFrame:
    """graph_id, nodes, n: from how many pairs hold a node set (column n) how many have just it in common; none are left out.

    A pair that holds a set holds its subsets too: these are taken off by inclusion and exclusion, with one row for each subset.
    """
    parts = held.filter("n > 0").withColumn("size", F.size("nodes")).select("graph_id", "n", "size", _subsets("nodes").alias("nodes"))
    sign = F.when((F.col("size") - F.size("nodes")) % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    return parts.groupBy("graph_id", "nodes").agg(F.sum(sign).alias("n")).filter("n > 0")


def _shared(a: DataFrame, b: DataFrame, low_first: bool = False) -> DataFrame:
    """graph_id, nodes, n: the common node sets of pairs of a subgraph of each side, and of how many pairs each is; sets may be repeated.

    ``low_first``: only pairs of which the left id is the smaller one.
    """
    left = a.select("graph_id", F.col("sg_id").alias("u"), F.explode("nodes").alias("n"))
    right = b.select("graph_id", F.col("sg_id").alias("v"), F.explode("nodes").alias("n"))
    both = met(left, right, ["graph_id", "n"])
    if low_first:
        both = both.filter(F.col("u") < F.col("v"))
    common = both.groupBy("graph_id", "u", "v").agg(F.sort_array(F.collect_list("n")).alias("nodes"))
    return common.groupBy("graph_id", "nodes").agg(F.count("*").alias("n"))


def _split(sets: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Sets of few nodes, sets of more, and whether there are any of these."""
    more = sets.filter(F.size("nodes") > FEW_NODES)
    return sets.filter(F.size("nodes") <= FEW_NODES), more, not more.isEmpty()


def _intersections(ag: AGFrame, met: DataFrame, all_pairs: DataFrame, node_size, must_be_connected: bool, name: str) -> AGFrame:
    low, high = (0, None) if node_size is None else span(node_size)
    sets = met.select("graph_id", "nodes").distinct()
    if not must_be_connected and low == 0:
        some = met.groupBy("graph_id").agg(F.sum("n").alias("met"))
        none = all_pairs.join(some, "graph_id", "left").filter(F.col("pairs") > F.coalesce("met", F.lit(0)))
        sets = sets.unionByName(none.select("graph_id", F.array().cast("array<bigint>").alias("nodes")))
    if node_size is not None:
        sets = sets.filter(F.size("nodes").between(low, high))
    params = {"must_be_connected": must_be_connected} | ({} if node_size is None else {"node_size": node_size})
    out = induced(ag, sets.withColumn("meta", meta_of(name, params, ag.chain, False)))
    return out.with_sg(out.sg.filter(n_components("nodes", "edges") == 1)) if must_be_connected else out


def _intersected(ag: AGFrame, sg: DataFrame, pairs_of, node_size, must_be_connected: bool, name: str, size_name: str, by_joins) -> AGFrame:
    """The distinct common node sets of a graph's pairs in one row, for graphs of few members; by joins for others."""
    low, high = (0, None) if node_size is None else span(node_size)
    params = {"must_be_connected": must_be_connected} | ({} if node_size is None else {size_name: node_size})

    def run(sets, g):
        left, right = pairs_of(sets)
        found = K.common_sets(left, right, not must_be_connected and low == 0)
        return (x for x in found if node_size is None or low <= len(x) <= high)

    def in_rows(ag: AGFrame, sg: DataFrame) -> AGFrame:
        out = global_nodes(replace(ag, sg=sg), run, name, params, streams=True)
        return out.with_sg(out.sg.filter(n_components("nodes", "edges") == 1)) if must_be_connected else out

    beyond = _beyond(sg, ROW_ITEMS)
    if beyond is None:
        found = in_rows(ag, sg).sg
    else:
        found = in_rows(ag, sg.join(beyond, "graph_id", "left_anti")).sg.unionByName(by_joins(lambda x: replace(x, sg=x.sg.join(beyond, "graph_id", "left_semi"))).sg)
    return replace(ag.with_sg(found, induced=True), distinct=True)


@operator("intersection", "preserve", node_size=None, must_be_connected=True)
def intersection(ag: AGFrame, node_size=None, must_be_connected: bool = True) -> AGFrame:
    """The distinct common node sets of all pairs of subgraphs, of a size in range and connected in the base graph.

    A graph's subgraphs are met in one row. In graphs of more members, pairs of subgraphs of few nodes aren't made, but counted by the node sets that they hold.
    """

    def by_joins(some) -> AGFrame:
        sg = _sets(some(ag))
        count = sg.groupBy("graph_id").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
        few, more, any_more = _split(sg)
        found = _exactly(_holding(few, "k").select("graph_id", "nodes", (F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("n")))
        if any_more:
            found = found.unionByName(_shared(more, more, True)).unionByName(_shared(more, few))
        return _intersections(ag, found, count, node_size, must_be_connected, "intersection")

    return _intersected(ag, ag.sg.select("graph_id", F.lit(0).cast("long").alias("ord"), "nodes"), lambda sets: (sets, None), node_size, must_be_connected, "intersection", "node_size", by_joins)


@operator("binary_intersection", "weak", "binary", first_second_node_size=None, must_be_connected=True)
def binary_intersection(a: AGFrame, b: AGFrame, first_second_node_size=None, must_be_connected: bool = True) -> AGFrame:
    """The distinct common node sets of one subgraph of each side; pairs are made as for ``intersection``."""

    def by_joins(some) -> AGFrame:
        left, right = _sets(some(a)), _sets(some(b))
        n = left.groupBy("graph_id").agg(F.count("*").alias("x")).join(right.groupBy("graph_id").agg(F.count("*").alias("y")), "graph_id")
        (few, more, any_more), (few_, more_, any_more_) = _split(left), _split(right)
        found = _exactly(_holding(few, "x").join(_holding(few_, "y"), ["graph_id", "nodes"]).select("graph_id", "nodes", (F.col("x") * F.col("y")).alias("n")))
        if any_more_:
            found = found.unionByName(_shared(left, more_))
        if any_more:
            found = found.unionByName(_shared(more, few_))
        return _intersections(a, found, n.select("graph_id", (F.col("x") * F.col("y")).alias("pairs")), first_second_node_size, must_be_connected, "binary_intersection")

    side = lambda x, k: x.sg.select("graph_id", F.lit(k).cast("long").alias("ord"), "nodes")
    sides = _with_sides(side(a, 0).unionByName(side(b, 1)))
    return _intersected(a, sides, _sides, first_second_node_size, must_be_connected, "binary_intersection", "node_size", by_joins)


def _tables(ag: AGFrame) -> tuple[DataFrame, DataFrame]:
    nodes = ag.base.select("graph_id", F.explode("nodes").alias("x")).select("graph_id", F.col("x.id").alias("node_id"))
    edges = ag.base.select("graph_id", F.explode("edges").alias("x")).select("graph_id", "x.src", "x.dst")
    return cut(nodes), cut(edges)


def _close(ag: AGFrame, left: DataFrame, right: DataFrame, low: int, high: int) -> DataFrame:
    """graph_id, u, v: the sets (graph_id, u or v, nodes) whose least base distance is in range and which lie in one component. Undirected.

    Nodes near any of a left set's are found first, each once a set; right sets are met at them.
    """
    nodes, edges = _tables(ag)
    part = cut(large.components(nodes, edges))
    each = lambda side, c: side.select("graph_id", c, F.explode("nodes").alias("node_id"))

    def whole(side: DataFrame, c: str) -> DataFrame:
        found = each(side, c).join(part, ["graph_id", "node_id"], "left").groupBy("graph_id", c)
        only = found.agg(F.min("component").alias(f"{c}_part"), F.max("component").alias("most"), F.count("*").alias("n"), F.count("component").alias("known"))
        return only.filter((F.col(f"{c}_part") == F.col("most")) & (F.col("n") == F.col("known"))).select("graph_id", c, f"{c}_part")

    near = large.within(nodes, edges, high).select("graph_id", F.col("centre").alias("node_id"), F.col("node_id").alias("m"), "hops")
    reached = met(each(left, "u"), cut(near), ["graph_id", "node_id"]).groupBy("graph_id", "u", F.col("m").alias("node_id")).agg(F.min("hops").alias("hops"))
    least = met(cut(reached), each(right, "v"), ["graph_id", "node_id"]).groupBy("graph_id", "u", "v").agg(F.min("hops").alias("hops")).filter(F.col("hops") >= low)
    return least.join(whole(left, "u"), ["graph_id", "u"]).join(whole(right, "v"), ["graph_id", "v"]).filter("u_part = v_part").select("graph_id", "u", "v")


#: Nodes, edges and members of subgraphs up to which a graph's subgraphs are combined in one row: of one side with itself, and of two sides.
ROW_ITEMS, ROW_ITEMS_OF_TWO = 4_000, 20_000
#: Unions of two sides of a graph among which repeated ones are left out at once, where each is wanted once.
HELD = 100_000


def _with_sides(sg: DataFrame) -> DataFrame:
    """Each list of nodes begins with its side, which is in column ord."""
    return sg.withColumn("nodes", F.concat(F.array("ord"), F.col("nodes")))


def _sides(sets: list[list[int]]) -> list[list[list[int]]]:
    return [[s[1:] for s in sets if s[0] == k] for k in (0, 1)]


def _combined(ag: AGFrame, sg: DataFrame, most: int, in_rows, by_joins) -> AGFrame:
    """Undirected: ``in_rows(collection)`` for the graphs of which base and subgraphs are small, ``by_joins(collection)`` for all others."""
    base, sg = cut(ag.base), cut(sg)
    items = base.select("graph_id", (F.size("nodes") + F.size("edges")).alias("n")).unionByName(sg.select("graph_id", (F.size("nodes") + 1).alias("n")))
    beyond = cut(items.groupBy("graph_id").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("graph_id"))
    if beyond.isEmpty():
        made = in_rows(replace(ag, base=base, sg=sg))
        out = ag.with_sg(made.sg, induced=True)
        return out if made.once is None else replace(out, once=(out.sg, *made.once[1:]))
    some = lambda how: replace(ag, base=base.join(beyond, "graph_id", how), sg=sg.join(beyond, "graph_id", how))
    return ag.with_sg(in_rows(some("left_anti")).sg.unionByName(by_joins(some("left_semi")).sg), induced=True)


def _numbered(ag: AGFrame, side: int, name: str) -> DataFrame:
    """graph_id, an id under ``name`` and nodes of the subgraphs of a side."""
    return cut(ag.sg.filter(F.col("ord") == side).select("graph_id", F.monotonically_increasing_id().alias(name), "nodes"))


@operator("combination", "weak", number_of_elements=(2, 2), distance=(0, 1))
def combination(ag: AGFrame, number_of_elements=(2, 2), distance=(0, 1)) -> AGFrame:
    """Unions of every choice of subgraphs, so many, each pair of which is at a base distance in range.

    A graph's subgraphs are combined in one row. Of larger undirected graphs the pairs in range are a graph over the subgraphs, whose
    cliques are the choices; of digraphs distances have a direction, so there rows are the only way.
    """
    count, far = span(number_of_elements), span(distance)
    params = {"number_of_elements": number_of_elements, "distance": distance}

    def in_rows(ag: AGFrame) -> AGFrame:
        return global_nodes(ag, lambda sets, g: K.combinations_within(g, sets, count, far), "combination", params, streams=True)

    def by_joins(ag: AGFrame) -> AGFrame:
        sets = _numbered(ag, 0, "u")
        close = _close(ag, sets, sets.withColumnRenamed("u", "v"), *far).filter("u < v")
        chosen = large.cliques(sets.select("graph_id", F.col("u").alias("node_id")), cut(close.select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"))), *count)
        of = chosen.select("graph_id", "members", F.explode("members").alias("u")).join(sets, ["graph_id", "u"])
        rows = of.groupBy("graph_id", "members").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("nodes")))).alias("nodes"))
        return induced(ag, rows.withColumn("meta", meta_of("combination", params, ag.chain, False)).select("graph_id", "nodes", "meta"))

    return in_rows(ag) if ag.directed else _combined(ag, ag.sg.select("graph_id", F.lit(0).cast("long").alias("ord"), "nodes"), ROW_ITEMS, in_rows, by_joins)


@operator("binary_combination", "weak", "binary", first_second_distance=(0, 1))
def binary_combination(a: AGFrame, b: AGFrame, first_second_distance=(0, 1)) -> AGFrame:
    """Unions of one subgraph of each side whose base distance is in range; of undirected graphs beyond a row by joins."""
    low, high = span(first_second_distance)
    params = {"first_second_distance": first_second_distance}

    def run(sets, g):
        left, right = _sides(sets)
        return (sorted({*x, *right[j]}) for x, near in zip(left, K.sets_near(g, low, high, left, right), strict=True) for j in sorted(near))

    def fewer(sets, g):
        """Without those that came up among the last HELD ones."""
        left, right = _sides(sets)
        right_, held = [frozenset(x) for x in right], set()
        for x, near in zip(map(frozenset, left), K.sets_near(g, low, high, left, right), strict=True):
            for j in near:
                if (found := x | right_[j]) not in held:
                    held.add(found)
                    yield found
            if len(held) > HELD:
                held.clear()

    def in_rows(ag: AGFrame) -> AGFrame:
        sides = replace(ag, sg=_with_sides(ag.sg))
        out = global_nodes(sides, run, "binary_combination", params, streams=True)
        return replace(out, once=(out.sg, global_nodes(sides, fewer, "binary_combination", params, streams=True).sg, False))

    def by_joins(ag: AGFrame) -> AGFrame:
        left, right = _numbered(ag, 0, "u"), _numbered(ag, 1, "v")
        near = cut(_close(ag, left, right, low, high)).join(left.withColumnRenamed("nodes", "x"), ["graph_id", "u"]).join(right.withColumnRenamed("nodes", "y"), ["graph_id", "v"])
        rows = near.select("graph_id", F.array_sort(F.array_union("x", "y")).alias("nodes"))
        return induced(ag, rows.withColumn("meta", meta_of("binary_combination", params, ag.chain, False)))

    side = lambda x, k: x.sg.withColumn("ord", F.lit(k).cast("long"))
    if a.directed:
        return in_rows(replace(a, sg=side(a, 0).unionByName(side(b, 1))))
    some = ("graph_id", "ord", "nodes")
    return _combined(a, side(a, 0).select(*some).unionByName(side(b, 1).select(*some)), ROW_ITEMS_OF_TWO, in_rows, by_joins)


def _streamed(rows: DataFrame, fn, schema: str, columns: tuple[str, ...]) -> DataFrame:
    """``fn(graph_id, rows of the graph) -> tuples of columns`` for each run of rows of one graph; rows of no graph are left out. Lists of nodes come as lists."""

    def run(batches):
        every = chain.from_iterable(zip(*(_lists_of(b.column(c)) for c in ("graph_id", *columns)), strict=True) for b in batches)
        for graph_id, own in groupby(every, itemgetter(0)):
            if graph_id is not None:
                yield from fn(graph_id, own)

    return rows.select("graph_id", *columns).mapInArrow(run, schema)


def _lists_of(column) -> list:
    """The values of a column; of lists the numbers at once, not one by one."""
    import pyarrow as pa

    if not pa.types.is_list(column.type) or column.null_count or pa.types.is_nested(column.type.value_type):
        return column.to_pylist()
    flat, at = column.flatten().to_pylist(), column.offsets.to_pylist()
    return [flat[a - at[0]:b - at[0]] for a, b in zip(at[:-1], at[1:], strict=True)]


def _beyond(sg: DataFrame, most: int) -> DataFrame | None:
    """The graphs whose subgraphs have more members, themselves counted; None if there are none."""
    found = cut(sg.groupBy("graph_id").agg(F.sum(F.size("nodes") + 1).alias("n")).filter(F.col("n") > most).select("graph_id"))
    return None if found.isEmpty() else found


#: Links that are handed on at once.
LINKS = 32_768
LINKED = "graph_id bigint, u bigint, v bigint, shared_base_nodes int, connected_by_base_edge boolean, u_nodes array<bigint>, v_nodes array<bigint>"


def _links_in_rows(ag: AGFrame, sg: DataFrame, together: bool, least: int, by_edge: bool) -> DataFrame:
    """The links with their ends' nodes, each graph by itself; subgraphs have the numbers that ``renumbered`` gives them. Rows are only shuffled if they aren't ``together``."""
    edges = F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["dst"])))  # they only tell subgraphs of equal nodes apart
    rows = sg.select("graph_id", "ord", "nodes", (F.array().cast("array<bigint>") if ag.induced else edges).alias("edges"))
    if by_edge:
        rows = rows.unionByName(ag.base.select("graph_id", F.lit(None).cast("long").alias("ord"), F.array().cast("array<bigint>").alias("nodes"), edges.alias("edges")))
    if by_edge or not together:
        rows = rows.repartition("graph_id").sortWithinPartitions("graph_id")

    def run(graph_id, own):
        import pyarrow as pa

        near, sets = defaultdict(set), []
        for _, order, nodes, edges in own:
            if order is not None:
                sets.append((order, len(nodes), nodes, edges))
                continue
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                near[a].add(b)
                near[b].add(a)
        sets = [x[2] for x in sorted(sets)]
        every, holders = pa.array(sets, pa.list_(pa.int64())), defaultdict(list)
        us, vs, common, joined = [], [], [], []

        def batch():
            u, v = pa.array(us, pa.int64()), pa.array(vs, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([graph_id] * len(us), pa.int64()), u, v, pa.array(common, pa.int32()), pa.array(joined, pa.bool_()), every.take(u), every.take(v)], NAMES)

        for v, nodes in enumerate(sets):
            shared = Counter(chain.from_iterable(holders[n] for n in nodes))
            by = {u for n in nodes for m in near.get(n, ()) for u in holders.get(m, ())} if by_edge else ()
            for u in shared.keys() | by if by else shared:
                if (k := shared[u]) >= least or u in by:
                    us.append(u)
                    vs.append(v)
                    common.append(k)
                    joined.append(u in by)
            for n in nodes:
                holders[n].append(v)
            if len(us) >= LINKS:
                yield batch()
                us, vs, common, joined = [], [], [], []
        if us:
            yield batch()

    NAMES = [x.split()[0] for x in LINKED.split(", ")]
    return _streamed(rows, run, LINKED, ("ord", "nodes", "edges"))


def _links_by_joins(base: DataFrame, sg: DataFrame, least: int, by_edge: bool) -> DataFrame:
    """The links with their ends' nodes, of subgraphs that are numbered."""
    member = sg.select("graph_id", F.col("sg_id").alias("u"), F.explode("nodes").alias("n"))
    other = member.select("graph_id", F.col("u").alias("v"), "n")
    shared = met(member, other, ["graph_id", "n"]).filter(F.col("u") < F.col("v")).groupBy("graph_id", "u", "v").agg(F.count("*").cast("int").alias("shared_base_nodes"))
    if by_edge:
        arcs = base.select("graph_id", F.explode(pairs(F.col("edges"))).alias("e")).select("graph_id", F.col("e.src").alias("n"), F.col("e.dst").alias("m"))
        arcs = arcs.unionByName(arcs.select("graph_id", F.col("m").alias("n"), F.col("n").alias("m")))
        joined = (
            met(met(member, arcs, ["graph_id", "n"]).select("graph_id", "u", F.col("m").alias("n")), other, ["graph_id", "n"])
            .filter(F.col("u") < F.col("v")).select("graph_id", "u", "v").distinct().withColumn("connected_by_base_edge", F.lit(True))
        )
        links = shared.join(joined.hint("merge"), ["graph_id", "u", "v"], "full_outer").select(
            "graph_id", "u", "v", F.coalesce("shared_base_nodes", F.lit(0)).alias("shared_base_nodes"), F.coalesce("connected_by_base_edge", F.lit(False)).alias("connected_by_base_edge"),
        ).filter((F.col("shared_base_nodes") >= least) | F.col("connected_by_base_edge"))
    else:
        links = shared.filter(F.col("shared_base_nodes") >= least).withColumn("connected_by_base_edge", F.lit(False))
    return _with_ends(links, sg)


def _with_ends(links: DataFrame, sg: DataFrame) -> DataFrame:
    """By sorting, as subgraphs are written too small to be kept from a broadcast."""
    side = lambda c: sg.select("graph_id", F.col("sg_id").alias(c), F.col("nodes").alias(f"{c}_nodes"))
    return links.join(side("u").hint("merge"), ["graph_id", "u"]).join(side("v").hint("merge"), ["graph_id", "v"])


@operator("intersection_edges", "preserve", size_threshold=1, accept_connection_by_edge=False)
def intersection_edges(ag: AGFrame, size_threshold: int = 1, accept_connection_by_edge: bool = False) -> AGFrame:
    """Links between subgraphs with so many common nodes and, if asked for, between those that a base edge joins.

    A graph's subgraphs are linked in its own rows, of which only one graph's are held; those of graphs of very many members by joins.
    """
    beyond, how = _beyond(ag.sg, ROW_ITEMS_OF_TWO), (size_threshold, accept_connection_by_edge)
    if beyond is None:
        found, sg = _links_in_rows(ag, ag.sg, ag.together is ag.sg, *how), renumbered(ag.sg)
    else:
        few, many = ag.sg.join(beyond, "graph_id", "left_anti"), cut(renumbered(ag.sg.join(beyond, "graph_id", "left_semi")))
        found = _links_in_rows(ag, few, False, *how).unionByName(_links_by_joins(ag.base.join(beyond, "graph_id", "left_semi"), many, *how))
        sg = renumbered(few).unionByName(many)
    out = ag.with_sg(sg, found.drop("u_nodes", "v_nodes"))
    return replace(out, linked=(out.links, found))


def linked_members(ag: AGFrame) -> DataFrame:
    """The links with both ends' node sets."""
    return ag.linked[1] if ag.linked is not None and ag.linked[0] is ag.links else _with_ends(ag.links, ag.sg)
