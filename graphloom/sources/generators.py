"""Seeded artificial graph collections; each graph is drawn on the executors from its own number."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import AGFrame, from_tables

#: Shapes, and the edge probability of the dense one.
SHAPES, DENSE = ("path", "cycle", "tree", "dense", "regular", "degree"), 0.45


def shape_edges(shape: str, n: int, rng: random.Random) -> set[tuple[int, int]]:
    """Edges of one graph over nodes 0 to n - 1."""
    if shape == "path":
        return {(i, i + 1) for i in range(n - 1)}
    if shape == "cycle":
        return {(i, i + 1) for i in range(n - 1)} | ({(0, n - 1)} if n > 2 else set())
    if shape == "tree":
        return {(rng.randrange(i), i) for i in range(1, n)}
    if shape == "dense":
        return {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < DENSE}
    if shape == "regular":
        return _regular(n, rng)
    if shape == "degree":
        hubs = max(1, n // 4)
        return {(0, i) for i in range(1, hubs)} | {(rng.randrange(hubs), i) for i in range(hubs, n)}
    raise ValueError(f"unknown shape {shape!r}")


def _regular(n: int, rng: random.Random, degree: int = 3) -> set[tuple[int, int]]:
    """A random graph in which every node has three neighbours; two, if that can't be. Ends are paired at random until all fit."""
    degree = min(degree, n - 1) - (n * min(degree, n - 1)) % 2
    while degree > 0:
        ends = [i for i in range(n) for _ in range(degree)]
        rng.shuffle(ends)
        made = {(min(a, b), max(a, b)) for a, b in zip(ends[::2], ends[1::2], strict=True) if a != b}
        if 2 * len(made) == len(ends):
            return made
    return set()


def _collection(spark: SparkSession, many: int, make, seed: int) -> AGFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(7)]
            for g in batch.column("id").to_pylist():
                nodes, edges, target = make(g, random.Random(f"{seed}:{g}"))
                for kind, rows in (("n", nodes), ("e", edges)):
                    for a, b, label, attribute in rows:
                        for column, v in zip(out, (g, kind, a, b, label, attribute, target), strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["graph_id", "kind", "a", "b", "label", "attribute", "target"])

    rows = spark.range(many).mapInArrow(run, "graph_id long, kind string, a long, b long, label string, attribute array<double>, target int")
    nodes = rows.filter("kind = 'n'").select("graph_id", F.col("a").alias("node_id"), "label", "attribute")
    edges = rows.filter("kind = 'e'").select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "label")
    return from_tables(nodes, edges, False, rows.groupBy("graph_id").agg(F.max("target").alias("target")))


def random_graphs(spark: SparkSession, many: int, shape: str = "dense", instance_size: int = 40, alphabet_size: int = 4, attribute_size: int = 3, seed: int = 0) -> AGFrame:
    """``many`` graphs of one shape with uniform labels and attributes."""

    def make(g, rng):
        nodes = [(i, 0, str(rng.randrange(alphabet_size)), [rng.random() for _ in range(attribute_size)]) for i in range(instance_size)]
        return nodes, [(a, b, "-", None) for a, b in sorted(shape_edges(shape, instance_size, rng))], None

    return _collection(spark, many, make, seed)


def labelled_graphs(spark: SparkSession, many: int, positive: str = "cycle", negative: str = "path", context: str = "path", target_size: int = 10, context_size: int = 10, links: int = 1, alphabet_size: int = 4, seed: int = 0) -> AGFrame:
    """``many`` of either kind, targets 1 and 0 in turn: a target shape and a context, joined by a few edges."""

    def make(g, rng):
        target = 1 - g % 2
        n = target_size + context_size
        nodes = [(i, 0, str(rng.randrange(alphabet_size)), [1.0]) for i in range(n)]
        edges = shape_edges(positive if target else negative, target_size, rng)
        edges |= {(a + target_size, b + target_size) for a, b in shape_edges(context, context_size, rng)}
        while len(edges) and links and sum(a < target_size <= b for a, b in edges) < min(links, target_size * context_size):
            edges.add((rng.randrange(target_size), target_size + rng.randrange(context_size)))
        return nodes, [(a, b, "-", None) for a, b in sorted(edges)], target

    return _collection(spark, 2 * many, make, seed)
