"""Graphs that don't fit into a row: node and edge tables, worked on by joins.

nodes: graph_id, node_id; edges: graph_id, src, dst. Direction is ignored unless said otherwise. Each operator gives a
table; lineage of iterations is cut in the folder that all executors share.

Among many graphs most are small. Joins by members would shuffle what each step makes of them; ``by_size`` has graphs of up to
ROW_ITEMS nodes and edges worked out whole, after one shuffle of these, and leaves the joins to the graphs beyond.
"""

from __future__ import annotations

from itertools import chain, groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import kernels as K
from .model import cut

KEY = ["graph_id", "node_id"]

#: Nodes and edges up to which a graph is worked out whole, and rows that are handed on at once.
ROW_ITEMS, FLUSH = 2_000, 8_192


def by_size(nodes: DataFrame, edges: DataFrame, small, columns: str, joins, directed: bool = False) -> DataFrame:
    """graph_id and ``columns``: what ``small(Graph)`` gives, row by row, for each graph of few nodes and edges, and ``joins(nodes, edges)`` for all others.

    Rows of a small graph follow one another in one partition, and are read as a stream; none is gathered into a list.
    """
    null = F.lit(None).cast("long")
    items = nodes.select("graph_id", F.col("node_id").alias("a"), null.alias("b")).unionByName(edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")))
    beyond = cut(items.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") > ROW_ITEMS).select("graph_id"))
    none = beyond.isEmpty()
    few = items if none else items.join(beyond, "graph_id", "left_anti")
    schema = f"graph_id long, {columns}"

    def run(batches):
        import pyarrow as pa

        kinds, out = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}, []
        named = [x.split() for x in schema.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(named)], [name for name, _ in named])
        every = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("graph_id", "a", "b")), strict=True) for b in batches)
        for graph_id, own in groupby(every, itemgetter(0)):
            ids, arcs = set(), set()
            for _, a, b in own:
                if b is None:
                    ids.add(a)
                elif a != b:
                    arcs.add((a, b) if directed or a < b else (b, a))
            for row in small(K.Graph(ids, [e for e in sorted(arcs) if e[0] in ids and e[1] in ids], directed)):
                out.append((graph_id, *row))
                if len(out) >= FLUSH:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    found = few.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(run, schema)
    if none:
        return found
    of = lambda side: cut(side.join(beyond, "graph_id", "left_semi"))
    return found.unionByName(joins(of(nodes), of(edges)).select(*found.columns))


#: Rows of one key that one block of a join by members holds.
HUB_ROWS = 4_096


def dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join them by, so that a key of very many rows is many tasks.

    The rows of a key beyond HUB_ROWS are dealt to blocks, and every block of the left meets every block of the right under a key of
    its own; so each pair of rows still meets exactly once. The keys that need it are written first and joined as a plain
    table, whose rows of one key adaptive execution may split.
    """

    def heavy(side: DataFrame, name: str) -> DataFrame:
        count = side.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HUB_ROWS)
        return count.select(*keys, F.ceil(F.col("_n") / HUB_ROWS).cast("int").alias(name))

    hubs = cut(heavy(left, "_l").join(heavy(right, "_r"), keys, "full_outer"))
    if hubs.isEmpty():
        return left, right, keys
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), one(F.col(n)) - 1))
    own = lambda side, n: F.pmod(F.xxhash64(*side.columns), one(F.col(n))).cast("int")
    a = left.join(hubs, keys, "left").withColumn("_i", own(left, "_l")).withColumn("_j", every("_r")).drop("_l", "_r")
    b = right.join(hubs, keys, "left").withColumn("_j", own(right, "_r")).withColumn("_i", every("_l")).drop("_l", "_r")
    return a, b, [*keys, "_i", "_j"]


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of a left and a right row of equal keys.

    By sorting: rows of members are written so small that a side of millions would pass for one to broadcast, through the driver.
    """
    a, b, on = dealt(left, right, keys)
    return a.join(b.hint("merge"), on).drop("_i", "_j")


def both_ways(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, near: each edge from either end, once; without loops."""
    ahead = edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("near"))
    back = edges.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("near"))
    return ahead.unionByName(back).filter(F.col("node_id") != F.col("near")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, degree of every node, 0 without edges."""
    ends = both_ways(edges).select(*KEY, F.lit(1).alias("one")).unionByName(nodes.select(*KEY, F.lit(0).alias("one")))
    return ends.groupBy(*KEY).agg(F.sum("one").cast("long").alias("degree"))


def components(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """graph_id, node_id, component: the smallest node of the node's connected component."""
    small = lambda g: ((n, part[0]) for part in K.components(g) for n in part)
    return by_size(nodes, edges, small, "node_id long, component long", lambda n, e: _components(n, e, most))


def _components(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``components`` by joins.

    Every round a node takes the smallest root among its own and its neighbours', hands it on to the node that was its
    root, and then takes its root's root: pointers double in length, so rounds grow as the logarithm of the diameter.
    """
    arcs = cut(both_ways(edges))
    at = cut(nodes.select(*KEY, F.col("node_id").alias("root")).distinct())
    for _ in range(most):
        seen = arcs.join(at.select("graph_id", F.col("node_id").alias("near"), "root"), ["graph_id", "near"]).groupBy(*KEY).agg(F.min("root").alias("seen"))
        new = at.join(seen, KEY, "left").select(*KEY, F.col("root").alias("old"), F.least("root", F.coalesce("seen", "root")).alias("root"))
        hooks = new.groupBy("graph_id", F.col("old").alias("node_id")).agg(F.min("root").alias("hook"))
        up = cut(new.join(hooks, KEY, "left").select(*KEY, "old", F.least("root", F.coalesce("hook", "root")).alias("root")))
        new = cut(up.join(up.select("graph_id", F.col("node_id").alias("root"), F.col("root").alias("next")), ["graph_id", "root"]).select(*KEY, "old", F.col("next").alias("root")))
        if new.filter(F.col("root") != F.col("old")).isEmpty():
            return new.select(*KEY, F.col("root").alias("component"))
        at = new.select(*KEY, "root")
    raise RuntimeError("components didn't settle")


def within(nodes: DataFrame, edges: DataFrame, radius: int, directed: bool = False) -> DataFrame:
    """graph_id, centre, node_id, hops: the nodes that each node reaches in ``radius`` steps at most, and how soon."""
    small = lambda g: ((c, n, hops) for c in g.nodes for n, hops in K.distances(g.out, c, radius).items())
    return by_size(nodes, edges, small, "centre long, node_id long, hops int", lambda n, e: _within(n, e, radius, directed), directed)


def _within(nodes: DataFrame, edges: DataFrame, radius: int, directed: bool) -> DataFrame:
    """``within`` by joins, one a step."""
    steps = edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("near")).distinct() if directed else both_ways(edges)
    found = nodes.select("graph_id", F.col("node_id").alias("centre"), "node_id", F.lit(0).alias("hops")).distinct()
    last = found
    for hop in range(1, radius + 1):
        ahead = last.join(steps, KEY).select("graph_id", "centre", F.col("near").alias("node_id")).distinct()
        last = cut(ahead.join(found.select("graph_id", "centre", "node_id"), ["graph_id", "centre", "node_id"], "left_anti").withColumn("hops", F.lit(hop)))
        found = found.unionByName(last)
    return found


def geodesics(nodes: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """graph_id, members: the distinct node sets, in order, of shortest paths of low to high edges."""
    return by_size(nodes, edges, lambda g: ((p,) for p in K.geodesics(g, low, high)), "members array<long>", lambda n, e: _geodesics(n, e, low, high))


def _geodesics(nodes: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """``geodesics`` by joins: paths that grow by a step each."""
    near = _within(nodes, edges, high, False)
    steps, paths, out = both_ways(edges), nodes.select("graph_id", F.col("node_id").alias("first"), "node_id", F.array("node_id").alias("members")), None
    for hop in range(1, high + 1):
        paths = paths.join(steps, KEY).select("graph_id", "first", F.col("near").alias("node_id"), F.array_append("members", F.col("near")).alias("members"))
        shortest = near.filter(F.col("hops") == hop).select("graph_id", F.col("centre").alias("first"), "node_id")
        paths = cut(paths.join(shortest, ["graph_id", "first", "node_id"]))
        if hop >= low:
            own = paths.select("graph_id", F.array_sort("members").alias("members"))
            out = own if out is None else out.unionByName(own)
    return out.distinct()


def merged(subgraphs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of all subgraphs (graph_id, sg_id, node_id) of each graph, and the edges between them."""
    nodes = subgraphs.select(*KEY).distinct()
    end = lambda c: nodes.select("graph_id", F.col("node_id").alias(c))
    return nodes, edges.join(end("src"), ["graph_id", "src"], "left_semi").join(end("dst"), ["graph_id", "dst"], "left_semi")


def cliques(nodes: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """graph_id, members: the node sets, in order, of all cliques of low to high nodes."""
    return by_size(nodes, edges, lambda g: ((sorted(c),) for c in K.cliques(g, low, high)), "members array<long>", lambda n, e: _cliques(n, e, low, high))


def _cliques(nodes: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """``cliques`` by joins.

    Edges lead from the node of fewer neighbours to that of more (equal ones by id), so few lead away from any node. A clique's members stand
    in that order. Two cliques that differ in their last member only make a larger one if an edge joins those two: one join by
    the common members, whose hot keys are split, and one semi-join a size.
    """
    arcs = both_ways(edges)
    degree = cut(arcs.groupBy(*KEY).agg(F.count("*").alias("degree")))
    place = lambda c: degree.select("graph_id", F.col("node_id").alias(c), F.struct("degree", "node_id").alias(f"{c}_at"))
    ahead = arcs.select("graph_id", F.col("node_id").alias("a"), F.col("near").alias("b")).join(place("a"), ["graph_id", "a"]).join(place("b"), ["graph_id", "b"]).filter(F.col("a_at") < F.col("b_at"))
    ahead = cut(ahead.select("graph_id", "a", "b", F.col("b_at").alias("last")))
    joined = ahead.select("graph_id", F.col("a").alias("x"), F.col("b").alias("y"))
    out = nodes.select("graph_id", F.array("node_id").alias("members")).distinct() if low <= 1 <= high else None
    own = ahead.select("graph_id", F.array("a").alias("before"), "last")
    for size in range(2, high + 1):
        if size > 2:
            pairs = met(own, own.withColumnRenamed("last", "next"), ["graph_id", "before"]).filter(F.col("last") < F.col("next"))
            pairs = pairs.withColumn("x", F.col("last.node_id")).withColumn("y", F.col("next.node_id")).join(joined, ["graph_id", "x", "y"], "left_semi")
            own = cut(pairs.select("graph_id", F.array_append("before", F.col("x")).alias("before"), F.col("next").alias("last")))
        if size >= low:
            found = own.select("graph_id", F.array_sort(F.array_append("before", F.col("last.node_id"))).alias("members"))
            out = found if out is None else out.unionByName(found)
    return nodes.select("graph_id", F.array("node_id").alias("members")).limit(0) if out is None else out


def graphlets(nodes: DataFrame, edges: DataFrame, radius: int, low: int, high: int) -> DataFrame:
    """graph_id, members: the connected node sets of low to high nodes, in order, that lie within a radius of some node."""
    return by_size(nodes, edges, lambda g: ((m,) for m in K.graphlets(g, radius, low, high)), "members array<long>", lambda n, e: _graphlets(n, e, radius, low, high))


def _graphlets(nodes: DataFrame, edges: DataFrame, radius: int, low: int, high: int) -> DataFrame:
    """``graphlets`` by joins.

    A set grows by a neighbour of any member; sets reached in several ways are one. A connected set of 2 * radius + 1 nodes
    lies within the radius of one of them; for larger ones the centres that reach all members are looked up.
    """
    steps = cut(both_ways(edges))
    own, out = nodes.select("graph_id", F.array("node_id").alias("members")).distinct(), None
    near = cut(_within(nodes, edges, radius, False).select("graph_id", "node_id", "centre")) if high > 2 * radius + 1 else None
    for size in range(1, high + 1):
        if size > 1:
            longer = met(own.select("graph_id", "members", F.explode("members").alias("node_id")), steps, KEY).filter(~F.array_contains("members", F.col("near")))
            own = cut(longer.select("graph_id", F.array_sort(F.array_append("members", F.col("near"))).alias("members")).distinct())
        if size >= low:
            found = own
            if size > 2 * radius + 1:
                reached = met(own.select("graph_id", "members", F.explode("members").alias("node_id")), near, KEY)
                found = reached.groupBy("graph_id", "members", "centre").agg(F.count("*").alias("n")).filter(F.col("n") == size).select("graph_id", "members").distinct()
            out = found if out is None else out.unionByName(found)
    return own.limit(0) if out is None else out


def betweenness(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """graph_id, node_id, score: the shares of shortest paths between other nodes that lead through each node.

    All sources at once, one table for each distance: how many shortest paths lead to a node, from those to the nodes before it;
    then, from the farthest on, how much of the paths beyond each node its predecessors carry. Undirected paths count both ways.
    """
    steps = cut(edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("near")).filter("node_id <> near").distinct() if directed else both_ways(edges))
    who = ["graph_id", "source", "node_id"]
    level = cut(nodes.select("graph_id", F.col("node_id").alias("source"), "node_id", F.lit(1.0).alias("paths")).distinct())
    levels, found = [], level.select(*who)
    while not level.isEmpty():
        levels.append(level)
        ahead = met(level, steps, KEY).groupBy("graph_id", "source", F.col("near").alias("node_id")).agg(F.sum("paths").alias("paths"))
        level = cut(ahead.join(found, who, "left_anti"))
        found = found.unionByName(level.select(*who))
    owed, scores = None, nodes.select(*KEY, F.lit(0.0).alias("score")).distinct()
    for before, after in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        far = after.withColumn("owed", F.lit(0.0)) if owed is None else after.join(owed, who, "left").withColumn("owed", F.coalesce("owed", F.lit(0.0)))
        share = far.select("graph_id", "source", F.col("node_id").alias("near"), ((1 + F.col("owed")) / F.col("paths")).alias("share"))
        back = met(before, steps, KEY).join(share, ["graph_id", "source", "near"])
        owed = cut(back.groupBy(*who).agg(F.sum(F.col("paths") * F.col("share")).alias("owed")))
        scores = scores.unionByName(owed.filter(F.col("source") != F.col("node_id")).select(*KEY, F.col("owed").alias("score")))
    return scores.groupBy(*KEY).agg(F.round(F.sum("score"), 9).alias("score"))


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, parent, depth: a breadth-first spanning tree of every component, from its smallest node (which has no parent)."""
    steps = cut(both_ways(edges))
    roots = components(nodes, edges).filter(F.col("node_id") == F.col("component"))
    last = cut(roots.select(*KEY, F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")))
    found, depth = last, 0
    while not last.isEmpty():
        depth += 1
        ahead = met(last.select(*KEY), steps, KEY).groupBy("graph_id", F.col("near")).agg(F.min("node_id").alias("parent")).withColumnRenamed("near", "node_id")
        last = cut(ahead.join(found.select(*KEY), KEY, "left_anti").select(*KEY, "parent", F.lit(depth).alias("depth")))
        found = found.unionByName(last)
    return cut(found)


def beyond_tree(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """graph_id, src, dst: the edges that aren't the tree's, each once with src < dst."""
    ends = F.struct(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    every = edges.filter("src <> dst").select("graph_id", ends.alias("e")).select("graph_id", "e.src", "e.dst").distinct()
    own = tree.filter(F.col("parent").isNotNull()).select("graph_id", F.least("node_id", "parent").alias("src"), F.greatest("node_id", "parent").alias("dst"))
    return every.join(own, ["graph_id", "src", "dst"], "left_anti")


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, src, dst: the edges on no cycle, with src < dst.

    Every edge beyond a spanning tree has a label, 128 bits of its hash, at both its ends. Labels are united (exclusive or) from the leaves
    up: below a tree edge those of edges that stay there cancel out, so what is left is zero if none leads out, but for one chance in 2^128.
    """
    tree = forest(nodes, edges)
    free = beyond_tree(edges, tree)
    marks = free.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"), F.xxhash64("graph_id", "src", "dst").alias("h"), F.xxhash64(F.lit("again"), "dst", "src", "graph_id").alias("k"))
    both = [F.bit_xor("h").alias("h"), F.bit_xor("k").alias("k")]
    held = cut(tree.join(marks.groupBy(*KEY).agg(*both), KEY, "left").select(*KEY, "parent", "depth", F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("k", F.lit(0)).alias("k")))
    deepest = held.agg(F.max("depth")).first()[0] or 0
    above, out = None, None
    for depth in range(deepest, 0, -1):
        level = held.filter(F.col("depth") == depth).select(*KEY, "parent", "h", "k")
        if above is not None:
            level = level.select(*KEY, "parent", "h", "k").unionByName(above.join(level.select(*KEY, "parent"), KEY).select(*KEY, "parent", "h", "k")).groupBy(*KEY, "parent").agg(*both)
        level = cut(level)
        above = level.groupBy("graph_id", F.col("parent").alias("node_id")).agg(*both)
        own = level.filter("h = 0 AND k = 0").select("graph_id", F.least("node_id", "parent").alias("src"), F.greatest("node_id", "parent").alias("dst"))
        out = own if out is None else out.unionByName(own)
    return free.limit(0) if out is None else out


def trees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, component: what is left without the edges on cycles, in components of two nodes or more."""
    small = lambda g: ((n, part[0]) for part in K.trees(g) for n in part)
    return by_size(nodes, edges, small, "node_id long, component long", _trees)


def _trees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``trees`` by joins."""
    left = cut(bridges(nodes, edges))
    ends = left.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return components(ends, left)


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, src, dst, node_id: a basis of the cycles, one for each edge beyond a spanning tree, and the nodes on it."""
    small = lambda g: ((u, v, n) for (u, v), ring in K.rings(g) for n in ring)
    return by_size(nodes, edges, small, "src long, dst long, node_id long", _cycles)


def _cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``cycles`` by joins.

    From the ends of the edge the tree is climbed, the deeper end first, until both meet.
    """
    tree = forest(nodes, edges)
    name = ["graph_id", "src", "dst"]
    up = lambda c: tree.select("graph_id", F.col("node_id").alias(c), F.col("parent").alias(f"{c}_up"), F.col("depth").alias(f"{c}_depth"))
    at = cut(beyond_tree(edges, tree).select(*name, F.col("src").alias("a"), F.col("dst").alias("b")))
    out = at.select(*name, F.explode(F.array("a", "b")).alias("node_id"))
    while not at.isEmpty():
        placed = at.join(up("a"), ["graph_id", "a"]).join(up("b"), ["graph_id", "b"])
        moved = placed.select(*name, F.when(F.col("a_depth") >= F.col("b_depth"), F.col("a_up")).otherwise(F.col("a")).alias("a"), F.when(F.col("b_depth") >= F.col("a_depth"), F.col("b_up")).otherwise(F.col("b")).alias("b"))
        moved = cut(moved)
        out = out.unionByName(moved.select(*name, F.explode(F.array("a", "b")).alias("node_id")))
        at = moved.filter("a <> b")
    return out.distinct()
