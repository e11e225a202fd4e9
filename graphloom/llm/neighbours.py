"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Largest inner product becomes least Euclidean distance by one more coordinate: x gets sqrt(M^2 - |x|^2), with M the
largest norm, and a query gets 0. Vectors are projected on a few Gaussian directions; a squared projected
distance is the squared distance times a chi-square variable. A kd-tree over the projections hands out points in
order of their projected distance, leaf by leaf; each is verified with its true inner product. The search of a query
ends once a point as near as its k-th best so far would, with probability ``certain``, have come already.

Every row is indexed. A seeded split of the projected space, fitted on a bounded sample, deals the rows into cells,
and a cell of many rows into blocks of bounded size; each block has its tree. A query first searches one block
of the cell nearest to it. With the k-th best found there it then goes to just those cells whose box doesn't pass the
stopping test; so a bound that one cell gives holds for all, and no vector travels to a query that can't need it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

DIRECTIONS, LEAF = 8, 128
#: Rows of a block; queries that are worked on at once, and those for which a block's rows travel once.
BLOCK_ROWS, QUERY_ROWS, PART_ROWS = 8_192, 1_024, 32_768
#: Projected rows that the cells are fitted on, and cells at most: what the driver sees and sends of them is bounded.
SAMPLE_ROWS, MOST_CELLS = 32_768, 1_024


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """Its distribution function, for an even number of degrees of freedom."""
    half = np.minimum(x, 1e4) / 2
    term, total = np.ones_like(x), np.zeros_like(x)
    for i in range(degrees // 2):
        total += term
        term = term * half / (i + 1)
    return 1.0 - np.exp(-half) * total


class Boxes:
    """Boxes of projected points, by their distance from queries."""

    low: np.ndarray
    high: np.ndarray

    def away(self, queries: np.ndarray) -> np.ndarray:
        """The least squared projected distance of each box from each query: [query, box]."""
        found = np.zeros((len(queries), len(self.low)))
        for d in range(queries.shape[1]):
            q = queries[:, d, None]
            out = np.maximum(np.maximum(self.low[None, :, d] - q, q - self.high[None, :, d]), 0.0)
            found += out * out
        return found


class Tree(Boxes):
    """kd-tree over projected points: leaves of at most LEAF points, each with its box."""

    def __init__(self, points: np.ndarray):
        self.leaves, low, high, stack = [], [], [], [np.arange(len(points))]
        while stack:
            part = stack.pop()
            own = points[part]
            lo, hi = own.min(axis=0), own.max(axis=0)
            if len(part) <= LEAF:
                self.leaves.append(part)
                low.append(lo)
                high.append(hi)
                continue
            order = np.argpartition(own[:, int((hi - lo).argmax())], len(part) // 2)
            stack += [part[order[: len(part) // 2]], part[order[len(part) // 2:]]]
        self.low, self.high = np.array(low), np.array(high)

    def nearest_first(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the leaves by their least squared projected distance, and these distances."""
        found = self.away(queries)
        order = np.argsort(found, axis=1, kind="stable")
        return order, np.take_along_axis(found, order, axis=1)


class Cells(Boxes):
    """Splits of the projected space, each at the median of what the sample has there; later the boxes of their rows."""

    def __init__(self, sample: np.ndarray, count: int):
        self.planes: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; below 0: cell -1 - number
        self.count = 0
        self.root = self._grow(sample, count)
        self.low = self.high = np.zeros((0, DIRECTIONS))
        self.blocks = np.zeros(0, dtype=np.int64)

    def _grow(self, own: np.ndarray, count: int) -> int:
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(1)
        if count < 2 or len(own) < 2 or not spread.max() > 0:
            self.count += 1
            return -self.count
        d = int(spread.argmax())
        value = float(np.quantile(own[:, d], (count // 2) / count, method="lower"))
        left = own[:, d] <= value
        if left.all():
            value = float(np.nextafter(own[:, d].max(), -np.inf))
            left = own[:, d] <= value
        at = len(self.planes)
        self.planes.append((d, value, 0, 0))
        self.planes[at] = (d, value, self._grow(own[left], count // 2), self._grow(own[~left], count - count // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, stack = np.zeros(len(points), dtype=np.int32), [(self.root, np.arange(len(points)))]
        while stack:
            at, part = stack.pop()
            if at < 0:
                out[part] = -1 - at
            elif len(part):
                d, value, left, right = self.planes[at]
                below = points[part, d] <= value
                stack += [(left, part[below]), (right, part[~below])]
        return out


def passes(near: np.ndarray, norms: np.ndarray, largest: float, worst: np.ndarray, certain: float) -> np.ndarray:
    """The stopping test: a point as near as the k-th best would, so surely, have a lesser projected distance."""
    away = np.where(np.isfinite(worst), np.maximum(norms + largest - 2 * np.where(np.isfinite(worst), worst, 0.0), 1e-12), np.inf)
    return chi_square(near / away, DIRECTIONS) >= certain


def search_block(tree: Tree, directions, ids, vectors, query_ids, queries, worst, k: int, certain: float, largest: float):
    """query, id and score of each query's best k of one block, by incremental search; and how many were verified.

    ``worst``: the k-th best score that each query has found elsewhere, or -inf.
    """
    dim = vectors.shape[1]
    order, near = tree.nearest_first(queries @ directions[:dim])
    norms = (queries * queries).sum(axis=1)
    best: list[list[tuple[float, int]]] = [[] for _ in queries]
    worst, verified = worst.copy(), 0
    active = np.arange(len(queries))
    for step in range(len(tree.leaves)):
        active = active[~passes(near[active, step], norms[active], largest, worst[active], certain)]
        if not len(active):
            break
        leaf_of = order[active, step]
        by_leaf = np.argsort(leaf_of, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf_of[by_leaf])) + 1):
            leaf, asking = tree.leaves[leaf_of[group[0]]], active[group]
            scores = queries[asking] @ vectors[leaf].T
            verified += scores.size
            q, p = np.nonzero(scores >= (worst[asking] - 1e-9 * (1 + np.abs(worst[asking])))[:, None])
            if not len(q):
                continue
            # Worked out row by row, so that equal vectors have equal scores wherever they stand.
            exact = (queries[asking[q]] * vectors[leaf[p]]).sum(axis=1)
            other = ids[leaf[p]] != query_ids[asking[q]]
            q, p, exact = q[other], p[other], exact[other]
            cut = np.flatnonzero(np.diff(q)) + 1
            for mine in np.split(np.arange(len(q)), cut) if len(q) else ():
                row = int(asking[q[mine[0]]])
                held = best[row] + [(-s, i) for s, i in zip(exact[mine].tolist(), ids[leaf[p[mine]]].tolist(), strict=True)]
                held.sort()
                best[row] = held[:k]
                if len(best[row]) == k:
                    worst[row] = max(worst[row], -best[row][-1][0])
    return [(int(query_ids[r]), i, -s) for r, held in enumerate(best) for s, i in held], verified


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part: with an id, a vector of finite numbers that isn't all zero."""
    v = F.col("v")
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(F.coalesce(good, F.lit(False)))


def _matrix(column, width: int) -> np.ndarray:
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _placed(rows: DataFrame, directions: np.ndarray, largest: float, cells: Cells | None) -> DataFrame:
    """cell, vec_id, v, p (the projected point) of every row; of no ``cells``: all in cell 0."""
    dim = len(directions) - 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dim)
            p = v @ directions[:dim] + np.sqrt(np.maximum(largest - (v * v).sum(axis=1), 0.0))[:, None] * directions[dim]
            of = cells.of(p) if cells else np.zeros(len(p), dtype=np.int32)
            points = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, DIRECTIONS, dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(of), batch.column("vec_id"), batch.column("v"), points], ["cell", "vec_id", "v", "p"])

    return rows.select("vec_id", "v").mapInArrow(run, "cell int, vec_id long, v array<double>, p array<double>")


def _routed(asked: DataFrame, directions: np.ndarray, largest: float, cells, k: int, certain: float, first: bool) -> DataFrame:
    """cell, block, vec_id, v, worst: where each query goes. ``first``: to one block of the nearest cell; else to all others that don't pass the test."""
    dim = len(directions) - 1

    def run(batches):
        import pyarrow as pa

        c = cells.value
        start = np.r_[0, np.cumsum(c.blocks)]
        cell_of = np.repeat(np.arange(len(c.blocks)), c.blocks)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                some = batch.slice(at, QUERY_ROWS)
                v, worst = _matrix(some.column("v"), dim), some.column("worst").to_numpy()
                near = c.away(v @ directions[:dim])
                nearest = near.argmin(axis=1)
                if first:
                    row, to = np.arange(len(v)), start[nearest]
                else:
                    goes = ~passes(near, (v * v).sum(axis=1)[:, None], largest, np.broadcast_to(worst[:, None], near.shape), certain)
                    goes = goes[:, cell_of]
                    goes[np.arange(len(v)), start[nearest]] = False
                    row, to = np.nonzero(goes)
                for b in range(0, len(row), 8 * QUERY_ROWS):
                    r, t = pa.array(row[b:b + 8 * QUERY_ROWS]), to[b:b + 8 * QUERY_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell_of[t].astype(np.int32)), pa.array((t - start[cell_of[t]]).astype(np.int32)), some.column("vec_id").take(r), some.column("v").take(r), some.column("worst").take(r)],
                        ["cell", "block", "vec_id", "v", "worst"],
                    )

    return asked.select("vec_id", "v", "worst").mapInArrow(run, "cell int, block int, vec_id long, v array<double>, worst double")


def _searched(held: DataFrame, going: DataFrame, directions: np.ndarray, largest: float, k: int, certain: float) -> DataFrame:
    """query_id, vec_id, score: the best of each block for the queries that go there; one row a block with the number verified.

    A block's rows travel once for each PART_ROWS of its queries, and only if there are any. A task holds one block
    and some of its queries at a time.
    """
    dim = len(directions) - 1
    parts = going.groupBy("cell", "block").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    sent = held.join(parts, ["cell", "block"]).select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asks"), "vec_id", "v", F.lit(0.0).alias("worst"))
    put = going.join(parts, ["cell", "block"]).select("cell", "block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("asks"), "vec_id", "v", "worst")

    def run(batches):
        import pyarrow as pa

        here, ids, vectors, tree, queries, waiting = None, [], [], None, [], 0
        table = lambda found, n: pa.RecordBatch.from_arrays([
            pa.array([None if n else x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([None if n else x[2] for x in found], pa.float64())], ["query_id", "vec_id", "score"])

        def answer():
            nonlocal tree, queries, waiting, ids, vectors
            if tree is None:
                ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                v = vectors[0]
                tree = Tree(v @ directions[:dim] + np.sqrt(np.maximum(largest - (v * v).sum(axis=1), 0.0))[:, None] * directions[dim])
            q, v, w = (np.concatenate(x) for x in zip(*queries, strict=True))
            queries, waiting = [], 0
            found, n = search_block(tree, directions, ids[0], vectors[0], q, v, w, k, certain, largest)
            yield table(found, False)
            yield table([(None, n, None)], True)

        for batch in batches:
            of = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "part", "asks")])
            cut = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
            for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, batch.num_rows].tolist(), strict=True):
                if a == b:
                    continue
                if here != tuple(of[:3, a]):
                    if waiting:
                        yield from answer()
                    here, ids, vectors, tree = tuple(of[:3, a]), [], [], None
                some = batch.slice(a, b - a)
                own, v = some.column("vec_id").to_numpy(), _matrix(some.column("v"), dim)
                if not of[3, a]:
                    ids.append(own)
                    vectors.append(v)
                    continue
                for c in range(0, b - a, QUERY_ROWS):
                    queries.append((own[c:c + QUERY_ROWS], v[c:c + QUERY_ROWS], some.column("worst").to_numpy()[c:c + QUERY_ROWS]))
                    waiting += len(queries[-1][0])
                    if waiting >= QUERY_ROWS:
                        yield from answer()
        if waiting:
            yield from answer()

    dealt = sent.unionByName(put).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "asks", "vec_id")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def search(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", certain: float = 0.97, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by ``every``.

    Candidates are all usable rows of the same length but those of the query's own id; of rows that repeat a query's
    id the one of the least vector asks. Null, empty, zero and non-finite vectors and rows without id take no part.
    Vectors of another length than a query's have no inner product with it: each length is searched among its own.
    Fewer candidates than k: all of them. Equal scores: smaller id first; repeated rows each are candidates. Extra columns
    are ignored. An empty table gives no rows.
    """
    near, _ = _search(df, every, k, id_col, vector_col, certain, seed)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def verified_share(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", certain: float = 0.97, seed: int = 11) -> float:
    """The share of all pairs of a query and a row that :func:`search` verifies."""
    _, verified = _search(df, every, k, id_col, vector_col, certain, seed)
    rows = usable(df, id_col, vector_col)
    asking = rows.filter(F.col("vec_id") % every == 0).select("vec_id").distinct().count()
    return verified.agg(F.sum("vec_id")).first()[0] / max(1, asking * rows.count())


def _search(df: DataFrame, every: int, k: int, id_col: str, vector_col: str, certain: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score of all blocks' best; the rows that count what was verified)."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(size).alias("largest"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asked")).filter("asked = 1").orderBy("dim").collect()
    found = None
    for dim, n, largest in ((r["dim"], r["n"], float(r["largest"])) for r in stats):  # one length, as a rule
        own = rows.filter(F.size("v") == dim)
        directions = np.random.default_rng(seed).standard_normal((dim + 1, DIRECTIONS))
        count = min(MOST_CELLS, math.ceil(n / BLOCK_ROWS))
        part = min(1.0, SAMPLE_ROWS / n)
        drawn = own.filter(F.xxhash64("vec_id", F.lit(seed)) <= F.lit(min(int((2 * part - 1) * 2.0**63), 2**63 - 1))).limit(2 * SAMPLE_ROWS)
        sample = np.array([r["p"] for r in _placed(drawn, directions, largest, None).select("p").collect()] if count > 1 else [], dtype=float).reshape(-1, DIRECTIONS)
        cells = Cells(sample, count)
        held = staged(_placed(own, directions, largest, cells), "placed")
        bounds = [f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(DIRECTIONS)]
        boxes = {r["cell"]: r for r in held.groupBy("cell").agg(F.count("*").alias("n"), *bounds).collect()}  # MOST_CELLS at most
        of = range(cells.count)
        cells.low, cells.high = (np.array([[boxes[c][f"{name}{d}"] if c in boxes else 1e100 for d in range(DIRECTIONS)] for c in of]) for name in ("low", "high"))
        cells.blocks = np.array([math.ceil(boxes[c]["n"] / BLOCK_ROWS) if c in boxes else 0 for c in of])
        shared = spark.sparkContext.broadcast(cells)
        blocks = F.element_at(F.array(*[F.lit(max(1, int(x))) for x in cells.blocks]), F.col("cell") + 1)
        held = held.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), blocks).cast("int"))
        asked = held.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        first = staged(_routed(asked.withColumn("worst", F.lit(float("-inf"))), directions, largest, shared, k, certain, True), "first")
        near = staged(_searched(held, first, directions, largest, k, certain), "near")
        bound = near.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        again = first.join(bound, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("worst"))
        going = staged(_routed(again, directions, largest, shared, k, certain, False), "going")
        discard(first)
        both = near.unionByName(staged(_searched(held, going, directions, largest, k, certain), "near"))
        discard(going)
        discard(held)
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    return found.filter(F.col("query_id").isNotNull()), found.filter(F.col("query_id").isNull())
