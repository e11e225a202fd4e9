"""Graphs that arrive over time: programs over each micro-batch, deduplication, and counts of labels in event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import GraphHashDeduper, apply, vectorize_graphs
from ..model import whole


def features_stream(base: DataFrame, directed: bool, program: Callable, out: str, checkpoint: str, nbits: int = 14, label_mode: str = "graph_hash", **trigger) -> StreamingQuery:
    """Append the graph features of each arriving graph (one row of ``base`` each) under ``out``.

    A batch's folder is named after the batch and written over if the batch is run again, so no graph counts twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        vectorize_graphs(apply(whole(batch, directed), program, nbits, label_mode)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return base.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def unique_graphs(base: DataFrame, directed: bool, time: str | None = None, keep: str | None = None, nbits: int = 31, known: DataFrame | None = None) -> DataFrame:
    """The arriving graphs (rows of ``base``, all columns) with their ``hash``, of isomorphic ones the first.

    The index of hashes is the stream's own state, kept by hash in its checkpoint, so it outlives a restart. With ``time`` and ``keep`` a hash is
    forgotten when the stream's time is ``keep`` beyond the graph; without, never. ``known``: hashes of graphs that were seen before, in
    a table, as :class:`GraphHashDeduper` has them; such graphs are left out.
    """
    named = base if "target" in base.columns else base.withColumn("target", F.lit(None).cast("int"))
    rows = named.withColumn("hash", GraphHashDeduper(nbits).code(whole(named, directed)))
    if known is not None:
        rows = rows.join(known.select("hash"), "hash", "left_anti")
    if time is None:
        return rows.dropDuplicates(["hash"])
    return rows.withWatermark(time, keep).dropDuplicatesWithinWatermark(["hash"])


def label_windows(nodes: DataFrame, time: str, label: str, width: str, late: str) -> DataFrame:
    """window, label, n: node labels in event-time windows; rows later than ``late`` are left out."""
    return nodes.withWatermark(time, late).groupBy(F.window(time, width), F.col(label).alias("label")).agg(F.count("*").alias("n"))
