"""Tables behind charts: label counts, Pareto fronts, method tables, nearest-neighbour votes, medoids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AGFrame


def label_counts(ag: AGFrame, edges: bool = False, top: int | None = None) -> DataFrame:
    """label, n, share: labels of nodes or edges, most frequent first, equal ones by name."""
    x = ag.base.select(F.explode("edges" if edges else "nodes").alias("x")).select(F.get("x.labels", F.size("x.labels") - 1).alias("label"))
    n = x.groupBy("label").agg(F.count("*").alias("n"))
    out = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("label", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row is sent
    return out if top is None else out.orderBy(F.desc("n"), "label").limit(top)


def size_counts(ag: AGFrame, edges: bool = False) -> DataFrame:
    """size, n: how many base graphs have so many nodes (or edges)."""
    return ag.base.groupBy(F.size("edges" if edges else "nodes").cast("long").alias("size")).agg(F.count("*").alias("n"))


def pareto_front(df: DataFrame, group: str, x: str, y: str, shells: int = 1, tolerance: float | None = None) -> DataFrame:
    """Rows with ``shell``: 1 for those that no other of the group beats in x (high) and y (low) at once, 2 once they are gone, and so on.

    With a ``tolerance`` a row is on a front if no row of the same or a higher x is lower in y by more than that.
    """
    left, found = df, None
    for shell in range(1, shells + 1):
        w = Window.partitionBy(group).orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, -1)
        better = F.min(y).over(w)
        level = F.min(y).over(Window.partitionBy(group, x))
        if tolerance is None:
            on = F.coalesce(F.col(y) < better, F.lit(True)) & (F.col(y) == level)
        else:
            on = F.col(y) <= F.least(level, F.coalesce(better, level)) + F.lit(tolerance)
        marked = left.withColumn("_on", on)
        own = marked.filter("_on").drop("_on").withColumn("shell", F.lit(shell).cast("long"))
        found = own if found is None else found.unionByName(own)
        left = marked.filter("NOT _on").drop("_on")
    return found


def method_table(df: DataFrame, dataset: str, method: str, value: str, order: str, methods: list[str]) -> DataFrame:
    """One row per dataset, one column per method; of several rows the last in order counts."""
    last = df.groupBy(dataset, method).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(dataset).pivot(method, methods).agg(F.first("v"))


#: Rows of a block of all rows, and of the queries that go past it.
ROWS, QUERIES = 16_384, 1_024
#: Rows of a group that one block holds.
BLOCK = 4_096


def knn_vote(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, label_col: str, k: int = 5) -> DataFrame:
    """id and vote: the label most frequent among the k nearest rows, itself left out; ties go to the smallest label.

    ``queries`` go past all rows of ``df``, block by block; of each block only their k nearest rows travel on.
    """
    vector = F.col(vector_col).cast("array<double>")
    blocks = F.lit(max(1, -(-df.count() // ROWS)))
    parts = F.lit(max(1, -(-queries.count() // QUERIES)))
    deal = lambda n: F.pmod(F.xxhash64(id_col), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    q = queries.select(F.col(id_col).alias("id"), vector.alias("v"), deal(parts).alias("part")).withColumn("block", every(blocks))
    c = df.select(F.col(id_col).alias("id"), vector.alias("v"), F.col(label_col).cast("long").alias("label"), deal(blocks).alias("block")).withColumn("part", every(parts))
    schema = "q long, c long, label long, d double"

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        matrix = lambda t: np.array(t.column("v").to_pylist(), dtype=float)
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, v, labels = left.column("id").to_numpy(), matrix(left), left.column("label").to_pylist()
            for i, x in zip(right.column("id").to_pylist(), matrix(right), strict=True):
                far = ((v - x) ** 2).sum(axis=1)
                far[ids == i] = np.inf
                near = np.lexsort((ids, far))[:k]
                for j in near[np.isfinite(far[near])].tolist():
                    for column, value in zip(out, (i, int(ids[j]), labels[j], float(far[j])), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("q", "c", "label", "d"), out, kinds, strict=True)})

    near = c.groupBy("block", "part").cogroup(q.groupBy("block", "part")).applyInArrow(run, schema)
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).filter(F.col("k") <= k)
    votes = ranked.groupBy("q", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("vote")).withColumnRenamed("q", id_col)


def mean_distances(df: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    """id and distance: each row's mean Euclidean distance to the other rows of its group, 0 for one alone.

    A group's rows are dealt to blocks that meet in pairs; of each pair only one sum a row travels on.
    """
    vector = F.col(vector_col).cast("array<double>")
    blocks = df.groupBy(group_col).agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = df.select(F.col(id_col).alias("id"), vector.alias("v"), F.col(group_col).alias("group")).join(blocks.withColumnRenamed(group_col, "group"), "group")
    own, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.withColumn("i", own).withColumn("j", every).select("group", "i", "j", "id", "v", "size")
    right = rows.withColumn("j", own).withColumn("i", every).select(F.col("group").alias("group_"), F.col("i").alias("i_"), F.col("j").alias("j_"), F.col("v").alias("w"))
    kind = dict(df.dtypes)[id_col]

    def run(a, b):
        import numpy as np
        import pyarrow as pa

        matrix = lambda t, c: np.array(t.column(c).to_pylist(), dtype=float)
        sums = np.zeros(a.num_rows)
        if a.num_rows and b.num_rows:
            x, y = matrix(a, "v"), matrix(b, "w")
            for k in range(len(x)):
                sums[k] = np.sqrt(((y - x[k]) ** 2).sum(axis=1)).sum()
        return pa.table({"id": a.column("id"), "size": a.column("size"), "far": pa.array(sums)})

    far = left.groupBy("group", "i", "j").cogroup(right.groupBy("group_", "i_", "j_")).applyInArrow(run, f"id {kind}, size long, far double")
    return far.groupBy("id").agg((F.sum("far") / F.greatest(F.max("size") - 1, F.lit(1))).alias("distance")).withColumnRenamed("id", id_col)


def medoids(df: DataFrame, id_col: str, vector_col: str, score_col: str, clusters: int = 4, seed: int = 0, cluster_col: str | None = None) -> DataFrame:
    """Rows of each cluster that no other beats in score (high) and mean distance to the cluster's other rows (low).

    Clusters are those in ``cluster_col``, or found here (bisecting k-means).
    """
    placed = df
    if cluster_col is None:
        from pyspark.ml.clustering import BisectingKMeans
        from pyspark.ml.functions import array_to_vector

        cluster_col = "cluster"
        rows = df.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
        placed = BisectingKMeans(k=clusters, seed=seed, featuresCol="_v", predictionCol=cluster_col).fit(rows).transform(rows).drop("_v")
    return pareto_front(placed.join(mean_distances(placed, id_col, vector_col, cluster_col), id_col), cluster_col, score_col, "distance")


def plane(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x, y: the rows on the two directions in which their vectors vary most, for a plot of an embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.filter(F.col(vector_col).isNotNull()).select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("_v"))
    placed = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("_p", vector_to_array("_p"))
    return placed.select(id_col, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))
