"""Graph collections over tables: each view makes node and edge rows with plain DataFrame operations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import AGFrame, from_tables, sized


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def basket(spark: SparkSession, sf_dir: str) -> AGFrame:
    """A graph for each customer: orders (even ids) and parts (odd ids), joined by line items."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), "o_orderkey", "o_orderpriority")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = o.join(li.hint("merge"), o.o_orderkey == li.l_orderkey)
    orders = o.select("graph_id", (F.col("o_orderkey") * 2).alias("node_id"), F.col("o_orderpriority").alias("label"))
    parts = lines.select("graph_id", "l_partkey").distinct().join(p.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select("graph_id", (F.col("p_partkey") * 2 + 1).alias("node_id"), F.col("p_type").alias("label"))
    edges = lines.select("graph_id", (F.col("o_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_returnflag").alias("label"))
    return from_tables(orders.unionByName(parts), edges, False)


def copart(spark: SparkSession, sf_dir: str) -> AGFrame:
    """A graph for each customer: parts, joined if they stand in one order."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), "o_orderkey")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").filter(F.col("l_partkey").isNotNull())
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = o.join(li.hint("merge"), o.o_orderkey == li.l_orderkey)
    nodes = lines.select("graph_id", "l_partkey").distinct().join(p.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select("graph_id", F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("label"))
    # an order's parts in a row: joined with themselves, lines would be sorted and counted twice as often in one task
    per_order = lines.groupBy("graph_id", "o_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    first = per_order.select("graph_id", "parts", F.posexplode("parts").alias("i", "src"))
    edges = first.select("graph_id", "src", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("dst"), F.lit("co").alias("label"))
    return from_tables(nodes, edges, False)


def session(spark: SparkSession, sf_dir: str) -> AGFrame:
    """A digraph for each user: event types, with an arc from each to the one that follows it at some time."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("graph_id"), "ts", "event_id", "event_type")
    kinds = e.select("event_type").distinct().withColumn("id", F.rank().over(Window.orderBy("event_type")).cast("long"))
    e = e.join(kinds, "event_type")
    follow = F.lead("id").over(Window.partitionBy("graph_id").orderBy("ts", "event_id"))
    nodes = e.select("graph_id", F.col("id").alias("node_id"), F.col("event_type").alias("label"))
    edges = e.withColumn("dst", follow).filter(F.col("dst").isNotNull()).select("graph_id", F.col("id").alias("src"), "dst", F.lit("then").alias("label"))
    return from_tables(nodes, edges, True)


def dialog(spark: SparkSession, sf_dir: str) -> AGFrame:
    """A digraph for each conversation: turns, with an arc to the turn whose number is next."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("node_id"), F.col("role").alias("label"))
    after = c.select("graph_id", (F.col("node_id") - 1).alias("node_id"))
    edges = c.join(after, ["graph_id", "node_id"]).select("graph_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"), F.lit("next").alias("label"))
    return from_tables(c, edges, True)


def geo(spark: SparkSession, sf_dir: str) -> AGFrame:
    """A directed tree for each region: region 0, nations, customers."""
    n, c = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer")
    nat = n.select(F.col("n_regionkey").cast("long").alias("graph_id"), F.col("n_nationkey").cast("long").alias("n"), "n_name")
    cust = c.select(F.col("c_nationkey").cast("long").alias("n"), F.col("c_custkey").alias("k"), "c_mktsegment").join(nat, "n")
    region = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("graph_id"), F.lit(0).cast("long").alias("node_id"), F.col("r_name").alias("label"))
    nodes = region.unionByName(nat.select("graph_id", (F.col("n") * 2 + 1).alias("node_id"), F.col("n_name").alias("label"))).unionByName(cust.select("graph_id", (F.col("k") * 2 + 2).alias("node_id"), F.col("c_mktsegment").alias("label")))
    edges = nat.select("graph_id", F.lit(0).cast("long").alias("src"), (F.col("n") * 2 + 1).alias("dst"), F.lit("has").alias("label")).unionByName(cust.select("graph_id", (F.col("n") * 2 + 1).alias("src"), (F.col("k") * 2 + 2).alias("dst"), F.lit("has").alias("label")))
    return from_tables(nodes, edges, True)


#: Columns of a parsed token; ``head`` is the place of the token that it hangs on, null for a root.
TOKEN = "graph_id long, node_id long, text string, lemma string, pos string, tag string, dep string, char_start long, char_end long, head long, label string"


def _tokens_in_order(text: str) -> list[dict]:
    """Words as tokens, each hanging on the one before it."""
    return [
        {"text": m[0], "lemma": m[0].lower(), "pos": None, "tag": None, "dep": "next", "char_start": m.start(), "char_end": m.end(), "head": i - 1 if i else None}
        for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text))
    ]


def parsed_tokens(texts: DataFrame, parse=None, id_col: str = "doc_id", text_col: str = "text", label: str = "text") -> DataFrame:
    """The TOKEN rows of each text. ``parse(text)`` gives a dictionary for each token; without one, words in order."""
    make, names = parse or _tokens_in_order, [x.split()[0] for x in TOKEN.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in TOKEN.split(", ")])
        for batch in batches:
            for graph_id, text in zip(batch.column("graph_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [{"graph_id": graph_id, "node_id": i, **t, "label": str(t.get(label) or "")} for i, t in enumerate(make(text or ""))]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=schema)

    return texts.select(F.col(id_col).cast("long").alias("graph_id"), F.col(text_col).alias("text")).mapInArrow(run, TOKEN)


def dependency_graphs(tokens: DataFrame) -> AGFrame:
    """A digraph for each text from its TOKEN rows: arcs from head to token, labelled by their relation."""
    edges = tokens.filter(F.col("head").isNotNull()).select("graph_id", F.col("head").alias("src"), F.col("node_id").alias("dst"), F.col("dep").alias("label"))
    return from_tables(tokens.select("graph_id", "node_id", "label"), edges, True)


def token_chain(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> AGFrame:
    """A digraph for each text: its words in order, each with a ``next`` arc to the following one."""
    words = texts.select(F.col(id_col).alias("graph_id"), F.posexplode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("node_id", "label"))
    edges = words.select("graph_id", (F.col("node_id") - 1).cast("long").alias("src"), F.col("node_id").cast("long").alias("dst"), F.lit("next").alias("label")).filter(F.col("src") >= 0)
    return from_tables(words.withColumn("node_id", F.col("node_id").cast("long")), edges, True)


def dom(spark: SparkSession, sf_dir: str) -> AGFrame:
    """A digraph for each page: its elements, with arcs from parent to child."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "html")

    def run(batches):
        import pyarrow as pa

        from .html_tree import elements

        for batch in batches:
            rows = [(p, *x) for p, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for x in elements(h or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())], ["graph_id", "node_id", "parent", "label"])

    found = pages.mapInArrow(run, "graph_id long, node_id long, parent long, label string")
    edges = found.filter(F.col("parent").isNotNull()).select("graph_id", F.col("parent").alias("src"), F.col("node_id").alias("dst"), F.lit("child").alias("label"))
    return from_tables(found.select("graph_id", "node_id", "label"), edges, True)
