"""Label, attribute and edge functions of subgraphs, and features from them.

A label names a feature: a number from 2 to 2^nbits - 1. String labels are hashed natively; the canonical hash of a
labelled graph is an Arrow function over each distinct input.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..model import SG_COLUMNS, AGFrame, renumbered, whole
from ..operators.algebra import linked_members
from ..operators.selection import label_at, with_labels
from . import kernels as K


def string_hash(text: Column, nbits: int) -> Column:
    """The bounded hash of a string, native: the low bits of the SHA-256 of its tagged JSON form."""
    if not 2 <= nbits <= 32:
        raise ValueError("nbits is from 2 to 32")
    safe = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    low = F.conv(F.right(F.sha2(F.concat(F.lit('["str","'), safe, F.lit('"]')), 256), F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit((1 << nbits) - 1))
    return F.pmod(low, F.lit((1 << nbits) - 2)) + F.lit(2)


def certificate(nodes: str | Column, edges: str | Column, directed: bool) -> Column:
    """A labelled graph's certificate, from nodes with ids and labels and edges with ends and labels.

    Python gets a graph as one string that names nodes by their places, and works out equal ones of a batch once, and keeps what came up last.
    """
    nodes, edges = (F.col(c) if isinstance(c, str) else c for c in (nodes, edges))
    ids = F.transform(nodes, lambda x: x["id"])
    place = lambda x: F.array_position(ids, x) - 1
    labels = F.transform(nodes, lambda x: F.coalesce(x["label"], F.lit("")))
    arcs = F.transform(edges, lambda e: F.concat_ws(",", place(e["src"]), place(e["dst"]), F.coalesce(e["label"], F.lit(""))))
    return _canonical(F.to_json(F.array(labels, arcs)), directed)


def shape(nodes: str, edges: str, directed: bool) -> Column:
    """The certificate of a subgraph all of whose labels are ``-``, from its own nodes and edges."""
    place = lambda x: F.array_position(nodes, x) - 1
    arcs = F.transform(edges, lambda e: F.concat_ws(",", place(e["src"]), place(e["dst"])))
    return _canonical(F.concat_ws(";", F.size(nodes), F.array_join(arcs, ";")), directed)


@lru_cache(1 << 15)
def _certificate(x: str, directed: bool) -> str:
    """The certificate of a graph in its string; a worker keeps those that came up last, as small ones come again in every batch."""
    if x.startswith("["):
        labels, arcs = json.loads(x)
        return K.canonical(dict(enumerate(labels)), {(int(u), int(v)): label for u, v, label in (a.split(",", 2) for a in arcs)}, directed)
    n, *arcs = x.split(";")
    return K.canonical(dict.fromkeys(range(int(n)), "-"), {tuple(map(int, a.split(","))): "-" for a in arcs if a}, directed)


def _canonical(text: Column, directed: bool) -> Column:
    @arrow_udf("string")
    def canonical(column):
        import pyarrow as pa

        coded = column.dictionary_encode()
        return pa.array([_certificate(x, directed) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return canonical.asNondeterministic()(text)  # else a filter on it would work it out again


def graph_hash(ag: AGFrame, nbits: int = 14, structure_only: bool = False) -> AGFrame:
    """Labels from the canonical form of each subgraph; with ``structure_only`` its labels count as blank, and none are looked up."""
    if structure_only:
        return ag.with_sg(ag.sg.withColumn("label", string_hash(shape("nodes", "edges", ag.directed), nbits)), ag.links)
    rows = with_labels(ag, ag.sg)
    code = string_hash(certificate("node_labels", "edge_labels", ag.directed), nbits)
    return ag.with_sg(rows.withColumn("label", code).select(*SG_COLUMNS), ag.links)


def graph_structure_hash(ag: AGFrame, nbits: int = 14) -> AGFrame:
    return graph_hash(ag, nbits, True)


def _by_string(ag: AGFrame, text: Column, nbits: int, missing: str) -> AGFrame:
    return ag.with_sg(ag.sg.withColumn("label", string_hash(F.coalesce(text, F.raise_error(F.lit(missing)).cast("string")), nbits)), ag.links)


def source_function_hash(ag: AGFrame, nbits: int = 14) -> AGFrame:
    """Labels from the name of the operator that made a subgraph."""
    return _by_string(ag, F.coalesce(F.col("meta.source_function"), F.lit("unknown")), nbits, "no source function")


def source_chain_hash(ag: AGFrame, nbits: int = 14) -> AGFrame:
    """Labels from the whole program that made a subgraph."""
    return _by_string(ag, F.col("meta.source_chain"), nbits, "a subgraph has no source chain")


def name_hash(ag: AGFrame, nbits: int = 14) -> AGFrame:
    """Labels from the user's name of a subgraph, else from its program."""
    return _by_string(ag, F.coalesce(F.col("meta.user_name"), F.col("meta.source_chain")), nbits, "a subgraph has neither a name nor a source chain")


def _attributes(ag: AGFrame, combine) -> AGFrame:
    """Graphs in which no node has an attribute need nothing of their nodes: every one counts as [1.0]."""
    none = ~F.exists("nodes", lambda n: n["attribute"].isNotNull())
    of = ag.base.select("graph_id", none.alias("_none"), F.when(none, None).otherwise(F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["attribute"].alias("attribute")))).alias("_bn"))
    own = F.transform(F.filter("_bn", lambda n: F.array_contains(F.col("nodes"), n["id"])), lambda n: F.coalesce(n["attribute"], F.array(F.lit(1.0))))
    start = F.transform(F.get(own, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(own, start, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    plain = F.array(F.size("nodes").cast("double"))
    value = F.when(F.col("_none"), combine(plain, F.size("nodes"))).otherwise(combine(total, F.size("nodes")))
    rows = ag.sg.join(of, "graph_id").withColumn("attribute", F.when(F.size("nodes") > 0, value).otherwise(F.array(F.lit(0.0))))
    return ag.with_sg(rows.select(*SG_COLUMNS), ag.links)


def sum_attribute(ag: AGFrame) -> AGFrame:
    """Element by element sum of the nodes' attributes; a missing one is [1.0]."""
    return _attributes(ag, lambda total, n: total)


def mean_attribute(ag: AGFrame) -> AGFrame:
    """Element by element mean of the nodes' attributes; [0.0] for an empty subgraph."""
    return _attributes(ag, lambda total, n: F.transform(total, lambda x: x / n))


# ---- features ----------------------------------------------------------------------------------


def to_array(ag: AGFrame) -> DataFrame:
    """graph_id, node_id, col, value: for every base node the attributes of its subgraphs, summed by label. Null labels count nowhere."""
    rows = ag.sg.filter(F.col("label").isNotNull()).withColumn("d", F.size("attribute")).select("graph_id", "nodes", "label", "d", F.posexplode("attribute").alias("pos", "x"))
    return rows.select("graph_id", F.explode("nodes").alias("node_id"), (F.col("label") * F.col("d") + F.col("pos")).alias("col"), "x").groupBy("graph_id", "node_id", "col").agg(F.sum("x").alias("value"))


def _degrees(ag: AGFrame) -> DataFrame:
    """Every base node's degree: the ends of all edges and the nodes themselves, counted together."""
    ends = F.concat(F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), F.lit(0).alias("one"))), F.transform("edges", lambda e: F.struct(e["src"].alias("id"), F.lit(1).alias("one"))), F.transform("edges", lambda e: F.struct(e["dst"].alias("id"), F.lit(1).alias("one"))))
    each = ag.base.select("graph_id", F.explode(ends).alias("x")).select("graph_id", F.col("x.id").alias("node_id"), "x.one")
    return each.groupBy("graph_id", "node_id").agg(F.sum("one").cast("double").alias("degree"))


def vectorize(ag: AGFrame) -> DataFrame:
    """Node features: :func:`to_array` with column 0 set to 1 and column 1 to the degree. Labels and attributes are those of ``ag``."""
    fixed = _degrees(ag).select("graph_id", "node_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("col"), F.lit(1.0).alias("value")), F.struct(F.lit(1).cast("long").alias("col"), F.col("degree").alias("value")))).alias("x"))
    return to_array(ag).filter(F.col("col") > 1).unionByName(fixed.select("graph_id", "node_id", "x.col", "x.value"))


def vectorize_graphs(ag: AGFrame) -> DataFrame:
    """Graph features, the sums of the nodes' ones; a subgraph adds its attribute once for each of its nodes, so nothing is exploded by node."""
    rows = ag.sg.filter(F.col("label").isNotNull()).withColumn("d", F.size("attribute")).select("graph_id", F.size("nodes").alias("n"), "label", "d", F.posexplode("attribute").alias("pos", "x"))
    counted = rows.withColumn("col", F.col("label") * F.col("d") + F.col("pos")).filter(F.col("col") > 1).groupBy("graph_id", "col").agg(F.sum(F.col("x") * F.col("n")).alias("value"))
    fixed = ag.base.select("graph_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("col"), F.size("nodes").cast("double").alias("value")), F.struct(F.lit(1).cast("long").alias("col"), (F.size("edges") * 2).cast("double").alias("value")))).alias("x"))
    return counted.unionByName(fixed.select("graph_id", "x.col", "x.value"))


def to_vectors(features: DataFrame, width: int, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """The keys and a sparse vector of their features. Arrow has no vectors, so they are made row by row, one for each key."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    keep = features.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("f"))
    make = F.udf(lambda cols, values: SparseVector(width, cols, values), VectorUDT())
    return keep.select(*keys, make("f.col", "f.value").alias("features"))


def feature_subgraphs(ag: AGFrame, nbits: int = 10) -> DataFrame:
    """label, digest, nodes, graph_id: one representative of each distinct labelled subgraph of each feature."""
    rows = with_labels(ag, graph_hash(ag, nbits).sg).withColumn("digest", F.sha2(certificate("node_labels", "edge_labels", ag.directed), 256))
    return rows.groupBy("label", "digest").agg(F.min(F.struct("graph_id", "nodes")).alias("x")).select("label", "digest", "x.graph_id", "x.nodes")


def by_label(ag: AGFrame, unique: bool = False) -> DataFrame:
    """label, graph_id, rank, nodes: a row for each subgraph; ``rank`` counts a label's subgraphs of one graph from 1. ``unique``: each node set once."""
    rows = ag.sg.select("label", "graph_id", "ord", "nodes", "edges")
    if unique:
        rows = rows.groupBy("label", "graph_id", "nodes").agg(F.min("ord").alias("ord"), F.min("edges").alias("edges"))
    order = Window.partitionBy("label", "graph_id").orderBy("ord", F.size("nodes"), "nodes", "edges")
    return rows.withColumn("rank", F.row_number().over(order)).select("label", "graph_id", "rank", "nodes")


class GraphHashDeduper:
    """Graphs by the hash of their canonical form; optionally with a payload column carried along.

    ``fit`` keeps, of equal graphs, the one of the largest id; ``filter`` gives the graphs that aren't among the fitted.
    """

    def __init__(self, nbits: int = 31, payload: str | None = None):
        self.nbits, self.payload, self.index = nbits, payload, None

    def code(self, ag: AGFrame) -> Column:
        """The hash of the graph in a row of ``base``."""
        label = lambda x: label_at(x["labels"], F.lit(ag.version)).alias("label")
        nodes = F.transform("nodes", lambda x: F.struct(x["id"].alias("id"), label(x)))
        edges = F.transform("edges", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), label(x)))
        return string_hash(certificate(nodes, edges, ag.directed), self.nbits)

    def hashed(self, ag: AGFrame) -> DataFrame:
        return ag.base.select("graph_id", self.code(ag).alias("hash"), *([self.payload] if self.payload else []))

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "hash"]
        return rows.groupBy("hash").agg(F.max_by(F.struct(*rest), "graph_id").alias("x")).select("hash", *[F.col(f"x.{c}").alias(c) for c in rest])

    def fit(self, ag: AGFrame) -> GraphHashDeduper:
        self.index = self._last(self.hashed(ag))
        return self

    def filter(self, ag: AGFrame) -> DataFrame:
        if self.index is None:
            raise ValueError("fit comes first")
        return self._last(self.hashed(ag).join(self.index.select("hash"), "hash", "left_anti"))

    def fit_filter(self, ag: AGFrame) -> DataFrame:
        return self.fit(ag).index


def to_graph(ag: AGFrame) -> DataFrame:
    """The flattened export: rows of kind base_node, base_edge, sg_node, sg_edge and abstract (membership)."""
    none = F.lit(None).cast("long")
    sg = ag.sg
    parts = [
        ag.base.select("graph_id", F.lit("base_node").alias("kind"), F.explode("nodes").alias("x")).select("graph_id", "kind", F.col("x.id").alias("a"), none.alias("b")),
        ag.base.select("graph_id", F.lit("base_edge").alias("kind"), F.explode("edges").alias("x")).select("graph_id", "kind", F.col("x.src").alias("a"), F.col("x.dst").alias("b")),
        sg.select("graph_id", F.lit("sg_node").alias("kind"), F.col("sg_id").alias("a"), none.alias("b")),
        sg.select("graph_id", F.lit("abstract").alias("kind"), F.col("sg_id").alias("a"), F.explode("nodes").alias("b")),
    ]
    if ag.links is not None:
        parts.append(ag.links.select("graph_id", F.lit("sg_edge").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inverse_mappings(ag: AGFrame) -> DataFrame:
    """graph_id, node_id and the ids of the subgraphs that hold the node; without links they are numbered first."""
    sg = renumbered(ag.sg) if ag.links is None else ag.sg
    return sg.select("graph_id", "sg_id", F.explode("nodes").alias("node_id")).groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_list("sg_id")).alias("sg_ids"))


def inverse_links(ag: AGFrame, with_nodes: bool = False) -> DataFrame:
    """graph_id, node_id, u, v: for every base node the links among the subgraphs that hold it, by the links' own ids; ``with_nodes``: and u_nodes, v_nodes.

    With :func:`inverse_mappings` this is the part of the interpretation graph that stands over each base node. A link's common nodes
    are looked up from its two ends, so nothing is gathered at a node.
    """
    if ag.links is None:
        raise ValueError("subgraphs have to be linked first")
    both = linked_members(ag)
    return both.select("graph_id", F.explode(F.array_intersect("u_nodes", "v_nodes")).alias("node_id"), "u", "v", *(["u_nodes", "v_nodes"] if with_nodes else []))


#: Names of the label modes.
LABEL_MODES = {"graph_hash": graph_hash, "graph_structure_hash": graph_structure_hash, "source_function_hash": source_function_hash, "source_chain_hash": source_chain_hash, "operator_hash": name_hash}


def apply(ag: AGFrame, program, nbits: int = 14, label_mode: str = "graph_hash", attribute=mean_attribute) -> AGFrame:
    """Run a program and finish it: labels by mode, then attributes."""
    return attribute(LABEL_MODES[label_mode](program(ag), nbits))


class GraphFeatures(Transformer):
    """A ``pyspark.ml`` stage: from rows of base graphs to a sparse vector of each graph's features.

    ``program`` is an operator or its XML. Input columns: graph_id, nodes, edges (and target); all are kept, with the
    vector in ``outputCol``.
    """

    def __init__(self, program, nbits: int = 10, label_mode: str = "graph_hash", directed: bool = False, outputCol: str = "features"):
        super().__init__()
        self.program, self.nbits, self.label_mode, self.directed, self.outputCol = program, nbits, label_mode, directed, outputCol

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from ..plans.programs import from_xml

        program = from_xml(self.program) if isinstance(self.program, str) else self.program
        base = dataset if "target" in dataset.columns else dataset.withColumn("target", F.lit(None).cast("int"))
        found = vectorize_graphs(apply(whole(base.select("graph_id", "target", "nodes", "edges"), self.directed), program, self.nbits, self.label_mode))
        return dataset.join(to_vectors(found, 1 << self.nbits).withColumnRenamed("features", self.outputCol), "graph_id", "left")


class NodeFeatures(GraphFeatures):
    """As :class:`GraphFeatures`, with one row for each node: graph_id, node_id and its vector."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from ..plans.programs import from_xml

        program = from_xml(self.program) if isinstance(self.program, str) else self.program
        base = dataset if "target" in dataset.columns else dataset.withColumn("target", F.lit(None).cast("int"))
        found = vectorize(apply(whole(base.select("graph_id", "target", "nodes", "edges"), self.directed), program, self.nbits, self.label_mode))
        return to_vectors(found, 1 << self.nbits, ("graph_id", "node_id")).withColumnRenamed("features", self.outputCol)
