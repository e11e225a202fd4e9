"""Exact n-gram Jaccard join with adaptive multi-match prefixes, and its components.

Each text becomes the set of its word n-grams, as 64-bit hashes. Equal sets are one class from the start,
so copies cost nothing further. Tokens are put in one global order. A fixed share of all tokens, picked by their
hash, comes first and is ordered by exact document frequency; the others, and those whose bucket shows them to be
frequent, follow by estimated frequency. The share is so large that an ordinary document finds its whole prefix in
tokens that stand nowhere else: it can't be similar to another and is done, without a row of it going on. Among the
documents that are left the same is done with all tokens, so that only those with too few tokens of their own go on.

If two sets of similarity t or more are cut to prefixes of |s| - ceil(t|s|) + l tokens, these share l tokens at
least. Each document that meets others picks its own l from the estimated cost of its candidates: a longer prefix
costs more rows, and as many more shared tokens as it asks for leave fewer candidates to verify. Two documents of
different l are held to the smaller of the two. A pair's rarest common token has a place in each of the shortest
prefixes, the earlier the nearer the two sizes are; pairs are made at such places only, and then have to share enough
tokens of their whole prefixes before they are verified on whole sets.

A group of thousands of near copies would give millions of pairs. Before pairs are made, clusters are
grown: in each group of documents with a common prefix token, members are verified against one leader, first the one
with the fewest tokens of its own, and linked ones become one cluster. Pairs are then made between clusters only, so no link between
different clusters is lost, and none within a cluster is needed for the components.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, discard, new_names, ngram_hashes, one_row_each, release, rows_among, staged, text_key, text_of, text_slices, words_by_row

#: Counters that estimate document frequencies; with 4 bytes each, the bound of what is broadcast (1 MB).
BUCKETS, SLICES = 1 << 18, 64
#: Cost of verifying a candidate, in prefix tokens, for each token of a set: its whole text has to travel.
VERIFY_COST = 0.12
#: Most matches that a prefix may ask for; a bound on its length, not on candidates.
MOST_MATCHES = 24
#: The counted share of all tokens, as a multiple of a prefix's share 1 - t.
COUNTED = 2.0
#: Frequencies from here on count as equal in the order of tokens; bounds what a task holds of one token.
OFTEN = 1_000
#: Pairs between clusters, per row of the token groups, below which clusters are grown no further; nor are they
#: where a round no longer helps.
PAIRS_PER_ROW, MOST_ROUNDS = 2.0, 8


def sets_of(raw, offsets, n: int):
    """For each row of a run of texts its sorted distinct n-gram hashes."""
    words, bounds, *_ = words_by_row(raw, offsets, lower=True)
    grams = ngram_hashes(words, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            yield ngram_hashes(words[a:b], b - a, seed=1)
        else:
            yield np.zeros(0, dtype=np.uint64)


def required(size, num: int, den: int):
    """ceil(t * size): the overlap that a set of this size needs with any similar one."""
    return -(-num * size // den)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or den * small < num * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _key(tokens: np.ndarray) -> tuple[int, int]:
    """96 bits that name a set, as a 64-bit and a 32-bit number."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=12).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _profile(rows: DataFrame, n: int) -> DataFrame:
    """id, tid, n, k1, k2 for each row; then, per task, the counts of token buckets in SLICES rows."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        counts, schema = np.zeros(BUCKETS, dtype=np.int64), None
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            schema = schema or batch.schema.field("id").type
            size, keys = [], []
            for _, _, raw, offsets in text_slices(batch.column("text")):
                fresh = []
                for s in sets_of(raw, offsets, n):
                    k = _key(s)
                    size.append(len(s))
                    keys.append(k)
                    if k not in seen:
                        if len(seen) < 200_000:
                            seen.add(k)
                        fresh.append(s)
                if fresh:
                    counts += np.bincount((np.concatenate(fresh) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            none = pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())
            k1, k2 = pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tid"), pa.array(size, pa.int64()), k1, k2, *none], ["id", "tid", "n", "k1", "k2", "slice", "counts"])
        if schema is not None:
            parts = [x.astype("<i8").tobytes() for x in counts.reshape(SLICES, -1)]
            blank = [pa.nulls(SLICES, kind) for kind in (schema, pa.binary(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["id", "tid", "n", "k1", "k2", "slice", "counts"])

    return rows.mapInArrow(run, f"id {kind}, tid binary, n long, k1 long, k2 int, slice int, counts binary")


def _loads(profile: DataFrame) -> np.ndarray:
    """The bucket counts over all documents: summed slice by slice on the executors; BUCKETS numbers reach the driver."""

    def add(key, batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS // SLICES, dtype=np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_py(), dtype="<i8")
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    def local(batches):
        import pyarrow as pa

        total = np.zeros((SLICES, BUCKETS // SLICES), dtype=np.int64)
        for batch in batches:
            for s, x in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                total[s] += np.frombuffer(x.as_py(), dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["slice", "counts"])

    parts = profile.filter(F.col("slice").isNotNull()).select("slice", "counts").mapInArrow(local, "slice int, counts binary")
    load = np.zeros((SLICES, BUCKETS // SLICES), dtype=np.int64)
    for r in parts.groupBy("slice").applyInArrow(lambda key, table: add(key, table.to_batches()), "slice int, counts binary").collect():
        load[r["slice"]] = np.frombuffer(r["counts"], dtype="<i8")
    return load.ravel().astype(np.float32)


def first_tokens(s: np.ndarray, load: np.ndarray, usual: float, share: float, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The counted tokens of a set, and of the others, in their order, those that its longest prefix may reach.

    Whether a token is counted depends on the token alone: on its hash, and on whether its bucket is a frequent one.
    """
    count = load[s & np.uint64(BUCKETS - 1)]
    counted = (s >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))
    counted &= count <= usual
    first, rest = s[counted], ~counted
    more = min(len(s), len(s) - required(len(s), num, den) + MOST_MATCHES) - len(first)
    if more <= 0:
        return first, s[:0]
    others, count = s[rest], count[rest]
    return first, others[np.lexsort((others, count))[:more]]


def _tokens(rows: DataFrame, n: int, num: int, den: int, load, share: float) -> DataFrame:
    """token, k1, tail for the first tokens of each distinct set; tail: k2 above, below the place among the uncounted.

    A counted token has place 0. Each set has a further row with n and the number of its counted tokens.
    """

    def run(batches):
        import pyarrow as pa

        loads, seen = load.value, set()
        usual = float(np.median(loads)) * 1.3 + 64  # a bucket above this holds a frequent token
        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column("text")):
                out, keys, sizes, counted = [], [], [], []
                for s in sets_of(raw, offsets, n):
                    if not len(s):
                        continue
                    k = _key(s)
                    if k in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(k)
                    first, others = first_tokens(s, loads, usual, share, num, den)
                    place = np.zeros(len(first) + len(others), dtype=np.int64)
                    place[len(first):] = np.arange(1, len(others) + 1)
                    out.append((np.concatenate([first, others]).view(np.int64), np.full(len(place), k[0], np.int64), place | k[1] << 32))
                    keys.append(k)
                    sizes.append(len(s))
                    counted.append(len(first))
                if not keys:
                    continue
                a = [np.concatenate(x) for x in zip(*out, strict=True)]
                none = pa.nulls(len(a[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([*map(pa.array, a), none, none], ["token", "k1", "tail", "n", "counted"])
                k1, tail = (np.array([k[i] for k in keys], dtype=np.int64) << 32 * i for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(k1 ^ tail), pa.array(k1), pa.array(tail), pa.array(sizes, pa.int64()), pa.array(counted, pa.int64())], ["token", "k1", "tail", "n", "counted"])

    return rows.mapInArrow(run, "token long, k1 long, tail long, n long, counted long")


def _met(tokens: DataFrame) -> DataFrame:
    """The rows of tokens that stand in several sets, with their number ``df`` (OFTEN at most), and the rows of sets.

    ``tokens`` comes in order of token, k1 and tail, all of a token in one task. A token's rows are held until they
    are OFTEN or end.
    """
    names = ["token", "k1", "tail", "n", "counted", "df"]

    def run(batches):
        import pyarrow as pa

        held, last = None, None  # the open token's rows (token, k1, tail) and how many, if it's known to be frequent; the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n")
            of_set = n.is_valid().to_numpy(zero_copy_only=False)
            if of_set.any():
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(of_set)) for c in names[:5]), pa.nulls(int(of_set.sum()), pa.int32())], names)
            cols = np.stack([batch.column(c).to_numpy()[~of_set] for c in names[:3]])
            if not cols.shape[1]:
                continue
            before = cols[:, :1] + 1 if last is None else last
            last = cols[:, -1:]
            shifted = np.concatenate([before, cols[:, :-1]], axis=1)
            cols = cols[:, (cols != shifted).any(axis=0)]  # a set may come from several tasks
            if held is not None:
                cols = np.concatenate([held[0], cols], axis=1)
            if not cols.shape[1]:
                continue
            start = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            count = np.diff(np.r_[start, cols.shape[1]])
            if held is not None and cols[0][0] == held[0][0][0]:
                count[0] += held[1]
            df = np.minimum(np.repeat(count, np.diff(np.r_[start, cols.shape[1]])), OFTEN)
            open_from, gone = int(start[-1]), 0
            if count[-1] >= OFTEN:  # known to be frequent: all but one row may go
                open_from, gone = cols.shape[1] - 1, int(count[-1]) - 1
            done = np.flatnonzero(df[:open_from] > 1)
            held = (cols[:, open_from:], gone)
            if len(done):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[done]) for x in cols), *[pa.nulls(len(done), pa.int64())] * 2, pa.array(df[done].astype(np.int32))], names)
        if held is not None:
            cols, gone = held
            df = min(cols.shape[1] + gone, OFTEN)
            if df > 1:
                m = cols.shape[1]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), *[pa.nulls(m, pa.int64())] * 2, pa.array(np.full(m, df, np.int32))], names)

    return tokens.repartition("token").sortWithinPartitions("token", "k1", "tail").mapInArrow(run, "token long, k1 long, tail long, n long, counted long, df int")


def _prefixes(met: DataFrame, num: int, den: int) -> DataFrame:
    """token, k1, k2, n, need, level, at, own: the prefixes of the sets that meet others, those tokens left out that meet none.

    ``at`` is the token's place in the set's order, ``own`` the first such place: so many tokens stand nowhere else.
    ``level`` is the least number of matches for whose prefix the token counts, ``need`` the number that the set asks
    for: of the prefixes that it could have the one whose rows and candidates cost least.
    """
    key = Window.partitionBy("k1", "k2")
    rows = met.select("token", "k1", F.shiftright("tail", 32).cast("int").alias("k2"), F.col("tail").bitwiseAND(0x7FFFFFFF).alias("place"), "n", "counted", "df")
    # The whole set's figures first: sets whose base prefix meets nobody leave before their rows are put in order.
    rows = rows.withColumns({
        "size": F.max("n").over(key), "first": F.max("counted").over(key), "shared": F.sum(F.when(F.col("n").isNull() & (F.col("place") == 0), 1).otherwise(0)).over(key),
        "late": F.min(F.when(F.col("place") > 0, F.col("place"))).over(key),
    })
    least = F.expr(f"CAST((size * {num} + {den - 1}) DIV {den} AS LONG)")
    rows = rows.withColumn("base", F.col("size") - least + 1).withColumn("alone", F.col("first") - F.col("shared"))
    meets = ((F.col("shared") > 0) & (F.col("alone") < F.col("base"))) | (F.col("late").isNotNull() & (F.col("first") + F.col("late") - 1 < F.col("base")))
    rows = rows.filter(F.col("n").isNull() & meets)
    order = key.orderBy("place", "df", "token")
    rows = rows.withColumn("at", F.when(F.col("place") > 0, F.col("first") + F.col("place") - 1).otherwise(F.col("alone") + F.row_number().over(order) - 1))
    rows = rows.withColumn("level", F.greatest(F.col("at") - F.col("base") + 2, F.lit(1)).cast("int")).filter(F.col("level") <= F.least(F.lit(MOST_MATCHES), least))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = F.count("*").over(upto) + F.lit(VERIFY_COST) * F.col("size") * F.sum(F.col("df") - 1).over(upto) / F.col("level")
    rows = rows.withColumn("cost", cost).withColumn("cost", F.when(F.col("level") > 1, F.col("cost")).otherwise(F.max(F.when(F.col("level") == 1, F.col("cost"))).over(key)))
    rows = rows.withColumn("need", F.min(F.struct("cost", "level")).over(key)["level"])
    rows = rows.withColumn("own", F.min("at").over(key))
    return rows.filter(F.col("level") <= F.col("need")).select("token", "k1", "k2", F.col("size").alias("n"), "need", "level", F.col("at").cast("long").alias("at"), F.col("own").cast("long").alias("own"))


def _still_met(prefixes: DataFrame) -> DataFrame:
    """Staged: the prefix rows whose tokens still stand in several of the sets that are left."""
    held = staged(prefixes, "prefixes")
    again = held.groupBy("token").agg(F.count("*").alias("met")).filter(F.col("met") > 1).select("token")
    left = staged(held.join(again, "token"), "left")
    discard(held)
    return left


def _verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar, judged on their whole sets."""

    def run(batches):
        import pyarrow as pa

        held: tuple[int, np.ndarray] = (-1, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            left, right, yes = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            one = (s for _, _, raw, off in text_slices(batch.column("a_text")) for s in sets_of(raw, off, n))
            b_text = batch.column("b_text")
            for i, s in enumerate(one):
                if held[0] != right[i]:
                    _, _, raw, off = next(text_slices(b_text.slice(i, 1)))
                    held = (right[i], next(sets_of(raw, off, n)))
                yes.append(similar(s, held[1], num, den))
            keep = [i for i, y in enumerate(yes) if y]
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in keep], pa.int64()), pa.array([right[i] for i in keep], pa.int64())], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
    both = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node of an edge table (a, b).

    Each round a node takes the smallest root among its own and its neighbours', hands it on to the node that was its
    root, and then takes its root's root: pointers double in length. Each round is a written table, and replaces the
    one before. The loop ends when nothing changes; ``most`` rounds without an end are an error.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = staged(both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "arcs")
    held = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")).select(F.col("u").alias("node"), "root"), "roots")
    for _ in range(most):
        at = held.select("node", "root")
        near = both.join(at.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        seen = at.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hooks = seen.groupBy(F.col("old").alias("h_node")).agg(F.min("root").alias("hook"))
        up = staged(seen.join(hooks, F.col("node") == F.col("h_node"), "left").select("node", "old", F.least("root", F.coalesce("hook", "root")).alias("root")), "roots")
        new = staged(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", "old", F.col("next").alias("root")), "roots")
        discard(held)
        discard(up)
        if new.filter(F.col("root") != F.col("old")).isEmpty():
            discard(both)
            return new
        held = new
    raise RuntimeError("components didn't settle")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, component_id and n_copies (rows of the same set).

    See :func:`classes`; this is its result without its keys.
    """
    return classes(df, id_col, text_col, n, num, den).drop("tid", "root")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per row of ``df``: doc_id, tid (SHA-256 of the text), n_shingles, component_id, n_copies and root (the component's own key).

    Two rows are linked if their sets have a Jaccard similarity of num/den or more; component_id is the
    smallest id that links lead to, itself included. Null, empty and wordless texts have no shingles, are
    linked with nothing and keep their own id. Rows of equal sets are one class, whatever their ids: repeated
    rows, repeated ids and null ids each give their row; null ids never are a component's name unless
    it holds nothing else. Very long texts take part whole. Extra columns are ignored, so their names can't clash.
    An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("tid", text_key("text"))
    profile = staged(_profile(rows.select("id", "tid", "text"), n), "profile")
    docs = profile.filter(F.col("slice").isNull()).select("id", "tid", "n", "k1", "k2")
    loads = spark.sparkContext.broadcast(_loads(profile))
    class_of = docs.filter(F.col("n") > 0).groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"), F.min(F.struct(F.col("id"), F.col("tid"))).alias("pick"))
    prefixes = lambda of, share: _still_met(_prefixes(_met(_tokens(of.select("text"), n, num, den, loads, share)), num, den))
    left = prefixes(rows, min(1.0, COUNTED * (den - num) / den))
    release(spark)
    # Only sets that still meet another one get a number, and their texts go to the executors that verify them.
    wanted = left.select("k1", "k2").distinct().join(class_of, ["k1", "k2"]).select("k1", "k2", "first_id", F.col("pick.id").alias("p_id"), F.col("pick.tid").alias("p_tid"))
    wanted = staged(wanted.withColumn("key", F.monotonically_increasing_id()), "wanted")
    discard(left)
    texts = one_row_each(rows, wanted.select("key", "p_id", "p_tid"), "key", "texts")
    left = prefixes(texts, 1.0)
    groups = staged(left.join(wanted.select("k1", "k2", "key"), ["k1", "k2"]).select("token", "key", "n", "need", "level", "at", "own"), "groups")
    discard(left)
    release(spark)
    roots, before = None, None
    for turn in range(MOST_ROUNDS):
        at = groups.filter(F.col("level") == 1)
        if roots is not None:
            at = at.join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
        at = at.withColumn("cluster", F.col("key") if roots is None else F.coalesce("root", "key"))
        sizes = at.groupBy("token", "cluster").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"))
        cross = staged(sizes.filter(F.col("all") * F.col("all") > F.col("own")), "cross")
        total = cross.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
        if not total["rows"]:
            discard(cross)
            break
        open_rows = staged(at.join(cross.select("token"), "token").select("token", "key", "n", "need", "at", "own", "cluster"), "open")
        discard(cross)
        # The first round is the leaders', unless hardly any pairs are there; later ones go by the pairs that would be made.
        between, count = None, total["pairs"]
        if turn or count <= PAIRS_PER_ROW * total["rows"]:
            between = staged(_between(open_rows, num, den), "between")
            count = between.count()
        last = count <= PAIRS_PER_ROW * total["rows"] or (turn > 1 and count > 0.7 * before) or turn == MOST_ROUNDS - 1
        before = count
        pairs = staged(_cross_pairs(open_rows, between, num, den) if last else _leader_pairs(open_rows, turn, num, den), "pairs")
        for table in (open_rows, between):
            if table is not None:
                discard(table)
        close = staged(_sharing(pairs, groups, num, den), "close")
        discard(pairs)
        pairs = close
        found = staged(_verify(pairs, texts, n, num, den), "links")
        discard(pairs)
        links = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        grown = components(links)
        for table in (found, roots):
            if table is not None:
                discard(table)
        roots = grown
        release(spark)
        if last:
            break
    discard(groups)
    discard(texts)
    linked = None
    if roots is not None:
        of = wanted.join(roots.select(F.col("node").alias("key"), "root"), "key").select("k1", "k2", "first_id", "root")
        names = of.groupBy("root").agg(F.min("first_id").alias("name"), F.min(F.struct("k1", "k2")).alias("of_root"))
        linked = staged(of.join(names, "root").select("k1", "k2", "name", "of_root"), "linked")
        discard(roots)
    discard(wanted)
    own = F.struct("k1", "k2")
    if linked is None:
        named = class_of.select("k1", "k2", F.col("first_id").alias("component_id"), "n_copies", own.alias("root"))
    else:
        named = class_of.join(linked, ["k1", "k2"], "left").select(
            "k1", "k2", F.when(F.col("of_root").isNull(), F.col("first_id")).otherwise(F.col("name")).alias("component_id"), "n_copies", F.coalesce("of_root", own).alias("root"),
        )
    out = docs.join(staged(named, "named"), ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias("doc_id"), "tid", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "root",
    )


def overlap(a: str, b: str, num: int, den: int) -> Column:
    """The least overlap at which sets of these sizes are similar."""
    return F.expr(f"CAST(({num} * ({a} + {b}) + {num + den - 1}) DIV {num + den} AS LONG)")


def _leader_pairs(rows: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """For each document the leader, of another cluster, with which it shares most tokens of the shortest prefixes.

    A token's leader is its holder with the fewest tokens of its own, in later turns that of smallest seeded hash. One
    pair per document; what is missed here is left to the pairs between clusters.
    """
    first = F.col("own") / F.col("n") if turn == 0 else F.lit(0.0)
    lead = rows.groupBy("token").agg(F.min(F.struct(first.alias("first"), F.xxhash64("key", F.lit(turn)).alias("h"), "key", "n", "cluster")).alias("lead"))
    met = (
        rows.join(staged(lead, "lead"), "token")
        .filter((F.col("cluster") != F.col("lead.cluster")) & (F.lit(den) * F.least("n", "lead.n") >= F.lit(num) * F.greatest("n", "lead.n")))
        .groupBy(F.col("key").alias("a"), F.col("lead.key").alias("b")).agg(F.count("*").alias("shared"))
    )
    return met.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")).select("a", "b")


def _between(rows: DataFrame, num: int, den: int) -> DataFrame:
    """token, ca, cb: the clusters of which some documents may have this token as their first common one.

    After place i of a set of n no more than n - i tokens can be common, which has to be enough for sets of the two sizes.
    """
    kinds = rows.groupBy("token", "cluster").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("room"))
    of = lambda s: kinds.select("token", F.col("cluster").alias(f"c{s}"), F.col("low").alias(f"l{s}"), F.col("high").alias(f"h{s}"), F.col("room").alias(f"r{s}"))
    sizes = (F.lit(den) * F.col("ha") >= F.lit(num) * F.col("lb")) & (F.lit(den) * F.col("hb") >= F.lit(num) * F.col("la"))
    return of("a").join(of("b"), "token").filter((F.col("ca") < F.col("cb")) & sizes & (F.least("ra", "rb") >= overlap("la", "lb", num, den))).select("token", "ca", "cb")


def _cross_pairs(rows: DataFrame, between: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of documents of the paired clusters with a common token at places where their first one may stand.

    Pairs within a cluster are never made.
    """
    side = lambda s: rows.select("token", F.col("cluster").alias(f"c{s}"), F.col("key").alias(s), F.col("n").alias(f"n{s}"), (F.col("n") - F.col("at")).alias(f"r{s}"))
    return (
        between.join(side("a"), ["token", "ca"]).join(side("b"), ["token", "cb"])
        .filter((F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")) & (F.least("ra", "rb") >= overlap("na", "nb", num, den)))
        .select("a", "b").distinct()
    )


def _sharing(pairs: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that share as many prefix tokens as the smaller of their two requirements asks for.

    With prefixes that leave out ra and rb tokens, the overlap is the shared ones and max(ra, rb) at most.
    """
    own = groups.groupBy("key").agg(F.collect_list(F.struct("token", "level")).alias("tokens"), F.first("n").alias("n"), F.first("need").alias("need"))
    side = lambda s: own.select(F.col("key").alias(s), F.col("tokens").alias(f"t{s}"), F.col("n").alias(f"n{s}"), F.col("need").alias(f"need{s}"))
    need = F.least("needa", "needb")
    upto = lambda s: F.transform(F.filter(f"t{s}", lambda x: x["level"] <= need), lambda x: x["token"])
    least = lambda s: F.expr(f"CAST((n{s} * {num} + {den - 1}) DIV {den} AS LONG)")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect(upto("a"), upto("b")))
    return both.filter(shared >= need + overlap("na", "nb", num, den) - F.greatest(least("a"), least("b"))).select("a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``df`` with one document of each component: that of the smallest id, with all columns of ``df``.

    If several texts of a component have that id, the one of the smallest SHA-256 stays; of rows that repeat both id
    and text one stays. Null, empty and wordless texts are linked with nothing and all stay; a null id counts as the
    largest. Texts of any length are compared whole. Columns of any name are kept. An empty table gives no rows.

    Only rows that may have to go are shuffled: a bit field of those rows' texts lets the others through.
    """
    found = staged(classes(df, id_col, text_col, n, num, den), "classes")
    named = found.filter(F.col("n_shingles") > 0)
    one = staged(named.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("component_id").alias("_id"), F.min("tid").alias("_tid")), "one")
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid"))
    marks = named.join(one, "root").select("doc_id", "tid", stays.alias("stays")).groupBy("doc_id", "tid").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    marks = staged(marks.filter(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), "stays"), "marks")
    discard(one)
    key, flag, mark = new_names(df.columns, 3)
    marks = marks.select(F.col("_id").alias(f"{key}_id"), F.col("_tid").alias(f"{key}_tid"), F.col("stays").alias(mark))
    rows = df.withColumn(key, text_key(text_of(text_col)))
    rows = rows.withColumn(flag, rows_among(marks.select(F.col(f"{key}_tid").alias("tid")))(F.xxhash64(key)))
    clear = rows.filter(~F.col(flag)).select(*columns(df))
    held = rows.filter(flag).join(marks, (F.col(key) == F.col(f"{key}_tid")) & F.col(f"`{id_col}`").eqNullSafe(F.col(f"{key}_id")), "left")
    single = held.filter(F.col(mark).isNull()).select(*columns(df))
    several = held.filter(F.col(mark)).dropDuplicates([id_col, key]).select(*columns(df))
    return clear.unionByName(single).unionByName(several)
