"""Collections of graphs as DataFrames.

``base`` has one row per graph with its nodes and edges in arrays, so that work inside one graph needs no
shuffle; ``sg`` has one row per mapped subgraph of a graph; ``links`` relates subgraphs of one graph.

base:  graph_id, target, nodes array<struct<id, labels array<string>, original string, attribute array<double>>>,
       edges array<struct<src, dst, labels array<string>, original string>>
sg:    graph_id, sg_id, nodes array<long>, edges array<struct<src, dst>>, version, label, attribute, ord, meta
links: graph_id, u, v, shared_base_nodes, connected_by_base_edge

Labels are kept in versions: a label rewriter adds one, and a subgraph keeps the version it was induced at.
Undirected edges are stored once, with src <= dst. A graph has to fit into one row; ``graphloom.large`` has
the operators of graphs that don't.

A subgraph names its parent by a hash of the parent's node and edge sets; the parents themselves stay in the
collections that they were made in, which a collection holds as unevaluated plans.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = "struct<source_function:string,params:map<string,string>,source_chain:string,user_name:string,parent:bigint>"
EDGE_SET = "array<struct<src:bigint,dst:bigint>>"
SG_COLUMNS = ("graph_id", "sg_id", "nodes", "edges", "version", "label", "attribute", "ord", "meta")


def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class AGFrame:
    """A collection of graphs of one directedness with their subgraphs and the links among these.

    ``induced``: all subgraphs have every base edge between their nodes; ``untouched``: they are the whole graphs; ``distinct``: no
    graph has two subgraphs of the same nodes, so that deduplication may be left out. ``most``: nodes that a subgraph has at most, where known.

    The others name the table that they tell of, and count as long as that is the collection's. ``together``: ``sg``, where a graph's rows follow
    one another in one task. ``once``: ``sg``, the same with less or none of its repeated node sets, and whether there are none. ``linked``:
    ``links``, the same with u_nodes and v_nodes.
    """

    base: DataFrame
    sg: DataFrame
    directed: bool
    links: DataFrame | None = None
    version: int = 0
    chain: str | None = None
    extra: dict = field(default_factory=dict)
    parents: tuple[DataFrame, ...] = ()
    induced: bool = False
    untouched: bool = False
    distinct: bool = False
    most: int | None = None
    together: DataFrame | None = None
    once: tuple[DataFrame, DataFrame, bool] | None = None
    linked: tuple[DataFrame, DataFrame] | None = None

    def with_sg(self, sg: DataFrame, links: DataFrame | None = None, induced: bool | None = None) -> AGFrame:
        """The same base with other subgraphs, whose parents may be the present ones."""
        return replace(self, sg=sg.select(*SG_COLUMNS), links=links, parents=(*self.parents, self.sg), induced=self.induced if induced is None else induced, untouched=False, distinct=False, most=None)

    @property
    def spark(self):
        return self.base.sparkSession

    def __add__(self, other: AGFrame | None) -> AGFrame:
        """Both sides' subgraphs; base graphs are united, the right side's labels and attributes winning."""
        if other is None or other == 0:
            return self
        if self.directed != other.directed:
            raise ValueError("collections of different directedness can't be added")
        if self.base is other.base:
            base, shift = self.base, 0
        else:  # the right side's label versions follow the left side's
            base, shift = _united(self, other), self.version + 1
        sg = self.sg.unionByName(other.sg.withColumns({"ord": F.col("ord") + F.lit(1 << 20), "version": F.col("version") + F.lit(shift)}))
        return replace(
            self, base=base, sg=renumbered(sg), links=None, version=max(self.version, other.version + shift),
            parents=tuple(dict.fromkeys((*self.parents, *other.parents))), induced=self.induced and other.induced, untouched=False, distinct=False, most=None,
        )


def padded(labels: Column, count: int) -> Column:
    """A list of label versions made ``count`` long: the last one goes on; a missing list is all null."""
    known = F.coalesce(labels, F.array(null_of("string")))
    return F.slice(F.concat(known, F.array_repeat(F.get(known, F.size(known) - 1), count)), 1, count)


def _united(a: AGFrame, b: AGFrame) -> DataFrame:
    """The nodes and edges of both sides' base graphs; label versions of the left, then of the right; else the right side counts."""

    def both(column: str, key: list[str], rest: list[str]) -> DataFrame:
        side = lambda ag, s: ag.base.select("graph_id", F.explode(column).alias("x")).select("graph_id", *[F.col(f"x.{k}").alias(k) for k in key], F.lit(True).alias(f"{s}_is"), *[F.col(f"x.{k}").alias(f"{s}_{k}") for k in ["labels", "original", *rest]])
        joined = side(a, "a").join(side(b, "b"), ["graph_id", *key], "full_outer")
        labels = F.concat(padded(F.col("a_labels"), a.version + 1), padded(F.col("b_labels"), b.version + 1))
        later = lambda k: F.when(F.col("b_is"), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k)
        return joined.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(*key, labels.alias("labels"), later("original"), *[later(k) for k in rest]))).alias(column))

    graphs = a.base.select("graph_id", F.lit(0).alias("side"), "target").unionByName(b.base.select("graph_id", F.lit(1).alias("side"), "target"))
    graphs = graphs.groupBy("graph_id").agg(F.max_by("target", "side").alias("target"))
    out = graphs.join(both("nodes", ["id"], ["attribute"]), "graph_id", "left").join(both("edges", ["src", "dst"], []), "graph_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(a.base.schema[c].dataType)).alias(c)
    return out.select("graph_id", "target", empty("nodes"), empty("edges"))


#: Input rows for which a shuffle has a partition, and shuffled bytes that one task reads; sorted and counted, rows are some 100 times as large in memory.
SHUFFLE_ROWS, TASK_BYTES = 50_000, 2 << 20


def sized(rows: DataFrame) -> DataFrame:
    """``rows`` as they are, after the session's shuffles were given a partition for so many of them at least.

    With a fixed number of partitions a task's share grows with the input. Adaptive execution unites small ones again, up to
    TASK_BYTES; a higher number and a smaller size stay.
    """
    conf, size = rows.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if rows.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(size)) > TASK_BYTES:
        conf.set(size, str(TASK_BYTES))
    wanted = -(-rows.count() // SHUFFLE_ROWS)
    if wanted > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(wanted))
    return rows


def base_from(nodes: DataFrame, edges: DataFrame, directed: bool, targets: DataFrame | None = None) -> DataFrame:
    """``base`` from node rows (graph_id, node_id, label[, attribute]) and edge rows (graph_id, src, dst, label).

    Self loops and repeated edges (the smallest label stays) are made simple. Edges of unknown nodes are an error
    of the caller; they are dropped when a subgraph is induced. Rows are shuffled by graph, once for all that follows.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that adaptive execution leaves graphs spread out
    if "attribute" not in nodes.columns:
        nodes = nodes.withColumn("attribute", null_of("array<double>"))
    n = (
        nodes.repartition(parts, "graph_id").groupBy("graph_id", "node_id").agg(F.min("label").alias("label"), F.min("attribute").alias("attribute"))
        .groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node_id").cast("long").alias("id"), F.array("label").alias("labels"), null_of("string").alias("original"), "attribute"))).alias("nodes"))
    )
    src, dst = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    e = (
        edges.filter(F.col("src") != F.col("dst")).select("graph_id", src.cast("long").alias("src"), dst.cast("long").alias("dst"), "label")
        .repartition(parts, "graph_id").groupBy("graph_id", "src", "dst").agg(F.min("label").alias("label"))
        .groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", F.array("label").alias("labels"), null_of("string").alias("original")))).alias("edges"))
    )
    none = F.array().cast("array<struct<src:bigint,dst:bigint,labels:array<string>,original:string>>")
    out = n.join(e.hint("merge"), "graph_id", "left").withColumn("edges", F.coalesce("edges", none))
    out = out.join(targets, "graph_id", "left") if targets is not None else out.withColumn("target", null_of("int"))
    return out.select(F.col("graph_id").cast("long").alias("graph_id"), "target", "nodes", "edges")


def shared_folder(spark) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a folder under /tmp, if driver and executors are one process; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"/tmp/graphloom-{spark.sparkContext.applicationId}"
    return found.rstrip("/")


#: Tables that this process has written to the shared folder, until they are cleared.
WRITTEN: list[str] = []


def new_table(spark, name: str) -> str:
    """A path of its own in the shared folder."""
    WRITTEN.append(f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def clear_tables(spark) -> int:
    """Delete all tables that were written on the way, once no result that reads them is needed any more; how many there were."""
    jvm, count = spark._jvm, len(WRITTEN)
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder and read again."""
    path = new_table(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(base: DataFrame, directed: bool) -> AGFrame:
    """The default: one subgraph per graph, the graph itself."""
    sg = base.select(
        "graph_id", F.lit(0).cast("long").alias("sg_id"), F.transform("nodes", lambda x: x["id"]).alias("nodes"), pairs(F.col("edges")).alias("edges"),
        F.lit(0).alias("version"), null_of("long").alias("label"), null_of("array<double>").alias("attribute"), F.lit(0).cast("long").alias("ord"), no_meta().alias("meta"),
    )
    return AGFrame(base, sg, directed, induced=True, untouched=True, distinct=True, together=sg)


def pairs(edges: Column) -> Column:
    return F.transform(edges, lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst")))


def from_tables(nodes: DataFrame, edges: DataFrame, directed: bool, targets: DataFrame | None = None) -> AGFrame:
    return whole(base_from(nodes, edges, directed, targets), directed)


def no_meta() -> Column:
    """The meta of a graph that no operator has touched: present, but empty."""
    fields = [("source_function", "string"), ("params", "map<string,string>"), ("source_chain", "string"), ("user_name", "string"), ("parent", "bigint")]
    return F.struct(*[null_of(kind).alias(name) for name, kind in fields])


def set_key() -> Column:
    """Names the subgraph in columns nodes and edges among those of its graph."""
    return F.xxhash64("nodes", "edges")


def meta_of(name: str, params: dict, chain: str | None, parent: bool | Column = True) -> Column:
    """The meta of a new subgraph; its parent is the subgraph in columns nodes and edges, a given key, or none."""
    shown = F.create_map(*[F.lit(x) for k, v in params.items() for x in (k, repr(v))]) if params else F.create_map().cast("map<string,string>")
    own = parent if isinstance(parent, Column) else set_key() if parent else null_of("bigint")
    return F.struct(
        F.lit(name).alias("source_function"), shown.alias("params"), (F.lit(chain) if chain else F.lit(name)).alias("source_chain"), null_of("string").alias("user_name"), own.alias("parent"),
    ).cast(META)


def induced(ag: AGFrame, rows: DataFrame) -> AGFrame:
    """Subgraphs from ``rows`` (graph_id, nodes, meta[, ord]): all base edges between the nodes, at the current label version."""
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.lit(0).cast("long"))
    of = ag.base.select("graph_id", pairs(F.col("edges")).alias("_base_edges"))
    inside = F.filter("_base_edges", lambda e: F.array_contains(F.col("nodes"), e["src"]) & F.array_contains(F.col("nodes"), e["dst"]))
    edges = F.when(F.size("nodes") < 2, F.array().cast(EDGE_SET)).otherwise(inside)
    return ag.with_sg(_fresh(rows.join(of, "graph_id").withColumn("edges", edges), ag.version), induced=True)


def following(ag: AGFrame, out: AGFrame) -> AGFrame:
    """``out``, each of whose rows is made of one subgraph of ``ag`` without a shuffle: a graph's rows follow one another if they did so before."""
    return replace(out, together=out.sg) if ag.untouched or ag.together is ag.sg else out


def kept(ag: AGFrame, rows: DataFrame) -> AGFrame:
    """Some of the subgraphs, induced anew unless they are already, at the current label version."""
    return ag.with_sg(_fresh(rows, ag.version)) if ag.induced else induced(ag, rows.select("graph_id", "nodes", "ord", "meta"))


def ready(ag: AGFrame, rows: DataFrame) -> AGFrame:
    """Subgraphs from ``rows`` (graph_id, nodes, edges, ord, meta) whose edges are all base edges between the nodes."""
    return ag.with_sg(_fresh(rows, ag.version), induced=True)


def edge_induced(ag: AGFrame, rows: DataFrame) -> AGFrame:
    """Subgraphs from ``rows`` (graph_id, edges, meta): these edges and their ends."""
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.lit(0).cast("long"))
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("edges", lambda e: e["src"]), F.transform("edges", lambda e: e["dst"]))))
    return ag.with_sg(_fresh(rows.withColumn("edges", F.sort_array("edges")).withColumn("nodes", ends), ag.version), induced=False)


def _fresh(rows: DataFrame, version: int) -> DataFrame:
    return rows.select(
        "graph_id", F.lit(0).cast("long").alias("sg_id"), "nodes", "edges", F.lit(version).alias("version"),
        null_of("long").alias("label"), null_of("array<double>").alias("attribute"), "ord", "meta",
    )


def renumbered(sg: DataFrame) -> DataFrame:
    """``sg`` with dense ids in each graph, in order of (ord, size, nodes, edges)."""
    order = Window.partitionBy("graph_id").orderBy("ord", F.size("nodes"), "nodes", "edges")
    numbered = sg.withColumn("sg_id", (F.row_number().over(order) - 1).cast("long"))
    return numbered.withColumn("ord", F.col("sg_id")).select(*SG_COLUMNS)


def members(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
