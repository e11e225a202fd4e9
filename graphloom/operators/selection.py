"""Filters, sampling, ranking, label rewriters, names and scalar reducers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import SG_COLUMNS, AGFrame, induced, kept, meta_of, padded, ready, renumbered
from .algebra import n_components
from .registry import operator, span
from .structure import local_parts, random_part


@operator("filter_by_number_of_connected_components", "weak", number_of_components=(1, 1))
def filter_by_number_of_connected_components(ag: AGFrame, number_of_components=(1, 1)) -> AGFrame:
    """Subgraphs whose number of components is in range."""
    return kept(ag, ag.sg.filter(n_components("nodes", "edges").between(*span(number_of_components))))


@operator("filter_by_number_of_nodes", "preserve", number_of_nodes=(1, 10))
def filter_by_number_of_nodes(ag: AGFrame, number_of_nodes=(1, 10)) -> AGFrame:
    """Subgraphs whose number of nodes is in range."""
    return kept(ag, ag.sg.filter(F.size("nodes").between(*span(number_of_nodes))))


@operator("filter_by_number_of_edges", "preserve", number_of_edges=(1, 10))
def filter_by_number_of_edges(ag: AGFrame, number_of_edges=(1, 10)) -> AGFrame:
    """Subgraphs whose number of edges is in range."""
    return kept(ag, ag.sg.filter(F.size("edges").between(*span(number_of_edges))))


def label_at(labels: Column, version: Column) -> Column:
    """The label of a version; a later version than there is means the last."""
    return F.get(labels, F.least(version, F.size(labels) - 1))


def with_labels(ag: AGFrame, sg: DataFrame, key: str = "label") -> DataFrame:
    """``sg`` with node_labels array<struct<id, label>> and edge_labels array<struct<src, dst, label>>, at each row's version.

    With ``key`` original_label the saved labels in their place; any other key is one that nothing has.
    """
    of = ag.base.select("graph_id", F.col("nodes").alias("_bn"), F.col("edges").alias("_be"))
    rows = sg.join(of, "graph_id")
    of_key = {"label": lambda x: label_at(x["labels"], F.col("version")), "original_label": lambda x: x["original"]}.get(key, lambda x: F.lit(None).cast("string"))
    nodes = F.transform(F.filter("_bn", lambda n: F.array_contains(F.col("nodes"), n["id"])), lambda n: F.struct(n["id"].alias("id"), of_key(n).alias("label")))
    edges = F.transform(
        F.filter("_be", lambda e: F.array_contains(F.col("edges"), F.struct(e["src"].alias("src"), e["dst"].alias("dst")))),
        lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), of_key(e).alias("label")),
    )
    return rows.withColumn("node_labels", nodes).withColumn("edge_labels", edges).drop("_bn", "_be")


def _by_label(ag: AGFrame, column: str, key: str, must, cannot) -> AGFrame:
    rows = with_labels(ag, ag.sg, key)
    value = lambda x: F.coalesce(x["label"], F.lit("0"))
    if must:
        rows = rows.filter(F.exists(column, lambda x: value(x).isin([str(m) for m in must])))
    if cannot:
        rows = rows.filter(~F.exists(column, lambda x: value(x).isin([str(m) for m in cannot])))
    return kept(ag, rows.select(*SG_COLUMNS))


@operator("filter_by_node_label", "preserve", key="label", must_have_one_of=None, cannot_have_any_in=None)
def filter_by_node_label(ag: AGFrame, key: str = "label", must_have_one_of=None, cannot_have_any_in=None) -> AGFrame:
    """Subgraphs with one of these node labels at least, and none of those; what has no such key counts as 0. An empty list asks for nothing."""
    return _by_label(ag, "node_labels", key, must_have_one_of, cannot_have_any_in)


@operator("filter_by_edge_label", "preserve", key="label", must_have_one_of=None, cannot_have_any_in=None)
def filter_by_edge_label(ag: AGFrame, key: str = "label", must_have_one_of=None, cannot_have_any_in=None) -> AGFrame:
    """Subgraphs with one of these edge labels at least, and none of those; what has no such key counts as 0. An empty list asks for nothing."""
    return _by_label(ag, "edge_labels", key, must_have_one_of, cannot_have_any_in)


def _stay(ag: AGFrame, rows: DataFrame) -> AGFrame:
    """``rows`` of the subgraphs as they are, with the links among them."""
    if ag.links is None:
        return ag.with_sg(rows)
    ids = rows.select("graph_id", F.col("sg_id").alias("id"))
    links = ag.links.join(ids.withColumnRenamed("id", "u"), ["graph_id", "u"], "left_semi").join(ids.withColumnRenamed("id", "v"), ["graph_id", "v"], "left_semi")
    return ag.with_sg(rows, links)


@operator("filter_by_sampling", "preserve", n_samples=1, seed=None)
def filter_by_sampling(ag: AGFrame, n_samples=1, seed=None) -> AGFrame:
    """A seeded sample of each graph's subgraphs: so many, or a fraction of them and one at least. A graph whose only subgraph is itself gives random parts."""
    of = ag.base.select("graph_id", F.size("nodes").alias("_n"), F.size("edges").alias("_e"))
    alone = ag.sg.groupBy("graph_id").agg(F.count("*").alias("_c"), F.max(F.size("nodes")).alias("_sn"), F.max(F.size("edges")).alias("_se")).filter(F.col("_c") == 1)
    whole = alone.join(of, "graph_id").filter((F.col("_sn") == F.col("_n")) & (F.col("_se") == F.col("_e"))).select("graph_id")
    drawn = random_part(n_samples=n_samples, seed=0 if seed is None else seed)(replace(ag, sg=ag.sg.join(whole, "graph_id", "left_semi"), links=None))
    several = replace(ag, sg=ag.sg.join(whole, "graph_id", "left_anti"))
    sampled = _sampled(several, n_samples, seed)
    return replace(sampled, sg=sampled.sg.unionByName(drawn.sg), parents=(*sampled.parents, *drawn.parents), induced=sampled.induced and drawn.induced)


def _sampled(ag: AGFrame, n_samples, seed) -> AGFrame:
    sg = renumbered(ag.sg) if ag.links is None else ag.sg
    by = Window.partitionBy("graph_id")
    order = by.orderBy(F.xxhash64(F.lit(0 if seed is None else int(seed)), "graph_id", "nodes", "edges"), "sg_id")
    many = F.lit(n_samples) if isinstance(n_samples, int) else F.greatest(F.lit(1), F.floor(F.count("*").over(by) * F.lit(float(n_samples))))
    ranked = sg.withColumn("_k", F.row_number().over(order)).withColumn("_many", many)
    return _stay(ag, ranked.filter(F.col("_k") <= F.col("_many")).select(*SG_COLUMNS))


def _ranking(ag: AGFrame, ranked_features) -> DataFrame:
    pairs = list(ranked_features.items()) if isinstance(ranked_features, dict) else [(x, len(ranked_features) - i) for i, x in enumerate(ranked_features)]
    return ag.spark.createDataFrame([(int(k), float(s)) for k, s in pairs], "label long, score double")


@operator("select_top_by_feature_ranking", "weak", ranked_features=(), max_num=1)
def select_top_by_feature_ranking(ag: AGFrame, ranked_features=(), max_num: int = 1) -> AGFrame:
    """Each graph's subgraphs of the highest-ranked labels; ties by id. Unlisted labels go."""
    sg = renumbered(ag.sg).join(_ranking(ag, ranked_features), "label")
    k = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("score"), "sg_id"))
    return ag.with_sg(sg.withColumn("_k", k).filter(F.col("_k") <= max_num).select(*SG_COLUMNS))


@operator("connected_components_from_feature_ranking", "weak", ranked_features=(), max_num_base_nodes=10, node_agg="sum", min_component_size=1)
def connected_components_from_feature_ranking(ag: AGFrame, ranked_features=(), max_num_base_nodes: int = 10, node_agg: str = "sum", min_component_size: int = 1) -> AGFrame:
    """Components of the base nodes with the highest scores, which they have from the labels of their subgraphs."""
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[node_agg]
    scored = ag.sg.join(_ranking(ag, ranked_features), "label").select("graph_id", F.explode("nodes").alias("n"), "score").groupBy("graph_id", "n").agg(how("score").alias("s"))
    k = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("s"), F.col("n").cast("string")))
    top = scored.withColumn("_k", k).filter(F.col("_k") <= max_num_base_nodes).groupBy("graph_id").agg(F.sort_array(F.collect_list("n")).alias("nodes"))
    params = {"max_num_base_nodes": max_num_base_nodes, "node_agg": node_agg, "min_component_size": min_component_size}
    picked = induced(ag, top.withColumn("meta", meta_of("connected_components_from_feature_ranking", params, ag.chain, False)))
    parts = local_parts(picked, K.components).filter(F.size("nodes") >= min_component_size)
    return ready(ag, parts.withColumn("meta", meta_of("connected_components_from_feature_ranking", params, ag.chain, False)))


# ---- labels ------------------------------------------------------------------------------------


def _relabelled(ag: AGFrame, new, original) -> AGFrame:
    """A new label version of every node and edge: ``new(last label, original label)``; the first rewriting saves the original."""

    def step(x: Column) -> Column:
        last = F.get(x["labels"], F.size(x["labels"]) - 1)
        return F.array_append(padded(x["labels"], ag.version + 1), new(last, x["original"]))

    keep = lambda x: original(F.get(x["labels"], F.size(x["labels"]) - 1), x["original"])
    nodes = F.transform("nodes", lambda x: F.struct(x["id"].alias("id"), step(x).alias("labels"), keep(x).alias("original"), x["attribute"].alias("attribute")))
    edges = F.transform("edges", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), step(x).alias("labels"), keep(x).alias("original")))
    return replace(ag, base=ag.base.withColumn("nodes", nodes).withColumn("edges", edges), version=ag.version + 1)


@operator("unlabel", "preserve", label="-")
def unlabel(ag: AGFrame, label: str = "-") -> AGFrame:
    """One label for all nodes and edges of the base graph; subgraphs already made keep theirs."""
    return _relabelled(ag, lambda last, original: F.lit(label), lambda last, original: F.coalesce(original, last))


@operator("prepend_label", "preserve", label="-")
def prepend_label(ag: AGFrame, label: str = "-") -> AGFrame:
    """A prefix to every label of the base graph."""
    return _relabelled(ag, lambda last, original: F.concat(F.lit(label), F.coalesce(last, F.lit(""))), lambda last, original: F.coalesce(original, last))


@operator("restore_label", "preserve", fallback=None, drop_original=False)
def restore_label(ag: AGFrame, fallback=None, drop_original: bool = False) -> AGFrame:
    """The saved labels again; ``fallback`` where none was saved."""
    back = lambda last, original: F.coalesce(original, F.lit(fallback).cast("string"), last)
    return _relabelled(ag, back, lambda last, original: F.lit(None).cast("string") if drop_original else original)


@operator("name", "preserve", text="default")
def name(ag: AGFrame, text: str = "default") -> AGFrame:
    """A user's name for every subgraph of the result; the input keeps its own."""
    return ag.with_sg(ag.sg.withColumn("meta", F.col("meta").withField("user_name", F.lit(text))), ag.links)


# ---- scalars -----------------------------------------------------------------------------------


#: The reducers that are worked out from the sizes of a graph's subgraphs, and their defaults.
BY_SIZE: dict[str, tuple] = {}


def _reduced(ag: AGFrame, columns: dict) -> DataFrame:
    """graph_id and ``columns``, functions of nodes, edges and number of a graph's subgraphs of each size. Subgraphs are counted by size first, in one pass."""
    sizes = ag.sg.groupBy("graph_id", F.size("nodes").alias("_n"), F.size("edges").alias("_e")).agg(F.count("*").alias("_k"))
    found = sizes.groupBy("graph_id").agg(*[value(F.col("_n"), F.col("_e"), F.col("_k")).alias(name) for name, value in columns.items()])
    return ag.base.select("graph_id").join(found, "graph_id", "left")


def scalars(ag: AGFrame, reducers: dict) -> DataFrame:
    """graph_id and a column for each reducer; those of the subgraphs' sizes from one pass over the subgraphs."""
    here = {name: op for name, op in reducers.items() if op.name in BY_SIZE}
    values = {name: (lambda n, e, k, op=op: BY_SIZE[op.name][0](n, e, k, **(BY_SIZE[op.name][1] | dict(op.params)))) for name, op in here.items()}
    out = _reduced(ag, values) if here else ag.base.select("graph_id")
    out = out.fillna(0, [name for name, op in here.items() if op.name == "number_of_interpretation_graph_nodes"])
    for name, op in reducers.items():
        if name not in here:
            out = out.withColumn(name, F.lit(0).cast("long")) if op.name == "number_of_interpretation_graph_edges" and ag.links is None else out.join(op(ag).withColumnRenamed("value", name), "graph_id")
    return out.select("graph_id", *reducers)


def _scalar(name: str, doc: str, value, **defaults):
    BY_SIZE[name] = value, defaults

    def run(ag: AGFrame, **params) -> DataFrame:
        return _reduced(ag, {"value": lambda n, e, k: value(n, e, k, **(defaults | params))})

    run.__doc__ = doc
    return operator(name, "agnostic", "scalar", **defaults)(run)


max_number_of_subgraph_nodes = _scalar("max_number_of_subgraph_nodes", "Most nodes of a subgraph; null without subgraphs.", lambda n, e, k: F.max(n).cast("long"))
min_number_of_subgraph_nodes = _scalar("min_number_of_subgraph_nodes", "Fewest nodes of a subgraph; null without subgraphs.", lambda n, e, k: F.min(n).cast("long"))
max_number_of_subgraph_edges = _scalar("max_number_of_subgraph_edges", "Most edges of a subgraph; null without subgraphs.", lambda n, e, k: F.max(e).cast("long"))
min_number_of_subgraph_edges = _scalar("min_number_of_subgraph_edges", "Fewest edges of a subgraph; null without subgraphs.", lambda n, e, k: F.min(e).cast("long"))
quantile_number_of_subgraph_nodes = _scalar("quantile_number_of_subgraph_nodes", "Quantile of the subgraphs' node counts, interpolated.", lambda n, e, k, q: F.percentile(n, F.lit(q), k), q=0.5)
quantile_number_of_subgraph_edges = _scalar("quantile_number_of_subgraph_edges", "Quantile of the subgraphs' edge counts, interpolated.", lambda n, e, k, q: F.percentile(e, F.lit(q), k), q=0.5)
BY_SIZE["number_of_interpretation_graph_nodes"] = (lambda n, e, k: F.sum(k)), {}


@operator("number_of_interpretation_graph_nodes", "agnostic", "scalar")
def number_of_interpretation_graph_nodes(ag: AGFrame) -> DataFrame:
    """Subgraphs of each graph."""
    return ag.base.select("graph_id").join(ag.sg.groupBy("graph_id").agg(F.count("*").alias("value")), "graph_id", "left").fillna(0, ["value"])


@operator("number_of_interpretation_graph_edges", "agnostic", "scalar")
def number_of_interpretation_graph_edges(ag: AGFrame) -> DataFrame:
    """Links of each graph."""
    if ag.links is None:
        return ag.base.select("graph_id", F.lit(0).cast("long").alias("value"))
    return ag.base.select("graph_id").join(ag.links.groupBy("graph_id").agg(F.count("*").alias("value")), "graph_id", "left").fillna(0, ["value"])


