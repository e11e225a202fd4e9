"""Mixing sources to target weights by capped water-filling, native DataFrame operations only.

Sources share a budget in proportion to their weights. A source that would be read more than
``max_epochs`` times is clamped there, and what it leaves is reshared among the others by weight until
none is above. In closed form: order the sources by limit per weight; the clamped ones are a prefix of
that order, and the level of water is the highest that any prefix gives.

Each source then takes every document floor(target / size) times, and once more the documents whose
seeded hash lies up to a threshold, chosen where the running size comes nearest to the rest. The hash is of the
id, the text and, for rows that repeat both within a source, their number among these; so each row is drawn by itself.

The plan has one row per source. Up to MOST_SENT sources it is broadcast; beyond, every row of it goes to SALTS
partitions, over which the rows of a source are spread. Either way a source with most of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, new_names, staged, text_of

#: Hash values have 60 bits; the upper 12 name a bucket, so that no source needs one long sort.
HASH_HEX, BUCKET_BITS = 15, 48
#: Rows of a plan that are broadcast at most (some 100 bytes each), and what a larger one is multiplied by.
MOST_SENT, SALTS = 50_000, 32
#: Classes of text hashes; a table of those that hold repeated rows is broadcast, this many rows at most.
CLASSES = 65_536


def text_size(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def number_of(text: Column) -> Column:
    """A number below 2^60 from a string; the same in every run."""
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX), 16, 10).cast("long")


def draw(id_col: Column, text_hash: Column, nth: Column, seed: int) -> Column:
    """A number below 2^60 from the id, the text and the row's number among equal ones, and the seed."""
    return number_of(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), text_hash.cast("string"), nth.cast("string")))


def same(left: dict[str, str]) -> Column:
    """Whether all these columns are equal or both null."""
    out = F.lit(True)
    for a, b in left.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def repeats(sized: DataFrame) -> DataFrame:
    """r_id, r_hash, r_source, r_part, offset: for rows that aren't the only ones of their id, text hash and source.

    ``sized`` is a written table; ``part`` names the task that wrote a row. Counted by task first, so that a group of
    any size is summed and numbered in pieces.
    """
    group = Window.partitionBy("doc_id", "hash", "source")
    counts = sized.groupBy("doc_id", "hash", "source", "part").agg(F.count("*").alias("n"))
    return (
        counts.withColumn("all", F.sum("n").over(group)).withColumn("offset", F.sum("n").over(group.orderBy("part")) - F.col("n")).filter(F.col("all") > 1)
        .select(F.col("doc_id").alias("r_id"), F.col("hash").alias("r_hash"), F.col("source").alias("r_source"), F.col("part").alias("r_part"), "offset")
    )


def numbered(sized: DataFrame, again: DataFrame) -> DataFrame:
    """``sized`` with nth: the row's number, from 1, among those of its id, text hash and source."""
    joined = sized.join(again, same({"doc_id": "r_id", "hash": "r_hash", "source": "r_source", "part": "r_part"}), "left")
    single = joined.filter(F.col("offset").isNull()).select(*columns(sized), F.lit(1).cast("long").alias("nth"))
    within = F.row_number().over(Window.partitionBy("doc_id", "hash", "source", "part").orderBy(F.lit(0)))
    return single.unionByName(joined.filter(F.col("offset").isNotNull()).withColumn("nth", F.col("offset") + within).select(*columns(sized), "nth"))


def by_source(rows: DataFrame, source: str, plan: DataFrame, plan_source: str, salt: Column) -> DataFrame:
    """``rows`` joined with the plan's row of their source, without a partition that holds a source's every row."""
    if plan.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return rows.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col(plan_source)))
    many = plan.withColumn("_salt_p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(many, F.col(source).eqNullSafe(F.col(plan_source)) & (F.col("_salt") == F.col("_salt_p"))).drop("_salt", "_salt_p")


def water_fill(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sources(source, source_size)`` with weight and target.

    Sources in code-point order, null last, take the weights in turn. One row per source: the windows
    over all rows see no more than the list of sources.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights)).cast("int") + 1).cast("long")
    by_limit = Window.orderBy((F.col("_limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sources.withColumn("_rank", rank).withColumn("weight", pick).withColumn("_limit", F.col("source_size") * max_epochs)
        .withColumn("_rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_top", F.max(F.struct((F.col("_rest") / F.col("_weights")).alias("level"), F.col("_rest").alias("rest"), F.col("_weights").alias("weights"))).over(whole))
    )
    share = F.col("_top.rest").cast("double") * F.col("weight") / F.col("_top.weights")
    return level.select("source", "source_size", "weight", F.when(share >= F.col("_limit"), F.col("_limit").cast("double")).otherwise(share).alias("target"))


def plan(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: source_size, target, epochs (whole readings) and upto (hash threshold of one more).

    ``sized``: source, size, h. Totals are summed by source and bucket before anything is ordered;
    only the bucket in which a source's threshold falls is looked at row by row.
    """
    buckets = staged(sized.groupBy("source", F.shiftright("h", BUCKET_BITS).alias("bucket")).agg(F.sum("size").alias("b_size")), "buckets")
    filled = staged(water_fill(buckets.groupBy("source").agg(F.sum("b_size").alias("source_size")), weights, max_epochs), "filled")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("epochs", epochs).withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size"))
    wanted = filled.select(F.col("source").alias("w_source"), "need")
    upto = Window.partitionBy("source").orderBy("bucket")
    at = (
        buckets.withColumn("done", F.sum("b_size").over(upto))
        .join(wanted, F.col("source").eqNullSafe(F.col("w_source")))
        .filter((F.col("done") > F.col("need")) & (F.col("done") - F.col("b_size") <= F.col("need")) & (F.col("b_size") > 0))
        .select("w_source", F.col("bucket").alias("w_bucket"), "need", (F.col("done") - F.col("b_size")).alias("base"))
    )
    inside = (
        sized.withColumn("bucket", F.shiftright("h", BUCKET_BITS))
        .join(at, F.col("source").eqNullSafe(F.col("w_source")) & (F.col("bucket") == F.col("w_bucket")))
        .groupBy("source", "h").agg(F.sum("size").alias("h_size"), F.first("need").alias("need"), F.first("base").alias("base"))
        .withColumn("done", F.col("base") + F.sum("h_size").over(Window.partitionBy("source").orderBy("h")))
    )
    # Up to each hash value, or to none of the bucket: whichever sum is nearest; the smaller on a tie.
    none = at.select(F.col("w_source").alias("source"), (F.shiftleft(F.col("w_bucket"), BUCKET_BITS) - 1).alias("h"), F.abs(F.col("base") - F.col("need")).alias("off"))
    nearest = (
        inside.select("source", "h", F.abs(F.col("done") - F.col("need")).alias("off")).unionByName(none)
        .groupBy("source").agg(F.min(F.struct("off", "h"))["h"].alias("upto"))
        .withColumnRenamed("source", "n_source")
    )
    return (
        filled.join(nearest, F.col("source").eqNullSafe(F.col("n_source")), "left")
        .select(F.col("source").alias("p_source"), "source_size", "target", "epochs", F.coalesce("upto", F.lit(-1).cast("long")).alias("upto"))
    )


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Staged: doc_id, source, size, hash, part and the draw h of every row; the texts are read once."""
    text = text_of(text_col)
    sized = staged(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_size(text).alias("size"), number_of(text).alias("hash"), F.spark_partition_id().alias("part")), "sizes")
    again = staged(repeats(sized), "repeats")
    out = sized.withColumn("nth", F.lit(1).cast("long")) if again.isEmpty() else staged(numbered(sized, again), "numbered")
    return out.withColumn("h", draw(F.col("doc_id"), F.col("hash"), F.col("nth"), seed))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """Per row of ``df``: doc_id, size, source, source_size, target, copies and taken (words, repeats counted).

    Null texts have size 0; null sources are one source, the last. Null and repeated ids and repeated rows are each
    drawn by themselves; rows equal in id, text and source are interchangeable. Very long texts count whole. A
    source of no words gets a target of 0. Ties of draws come together. Extra columns are ignored. An empty table
    gives no rows. The sizes are written once to the shared folder, the texts are read once.
    """
    sized = _sized(df, id_col, text_col, source_col, seed)
    p = staged(plan(sized, weights, max_epochs), "plan")
    copies = F.col("epochs") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)
    return by_source(sized, "source", p, "p_source", F.col("h")).select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def materialise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken, with its own columns, of any names.

    A document that the mix takes no time is not in it; that is what the target weights ask for. Null and empty texts
    have size 0: a row without words is drawn like any other. Of rows equal in id, text and source as many are
    taken as :func:`mixed` says, any of them. Very long texts count whole. An empty table gives no rows.
    """
    sized = _sized(df, id_col, text_col, source_col, seed)
    p = staged(plan(sized, weights, max_epochs).select("p_source", "epochs", "upto"), "plan")
    names = {f"_own{i}": c for i, c in enumerate(df.columns)}
    own = df.select(*[c.alias(a) for a, c in zip(names, columns(df), strict=True)], F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), number_of(text_of(text_col)).alias("hash"))
    several = sized.filter(F.col("nth") > 1).select(F.col("doc_id").alias("r_id"), F.col("hash").alias("r_hash"), F.col("source").alias("r_source")).distinct()
    if several.isEmpty():
        own = own.withColumn("nth", F.lit(1).cast("long"))
    else:  # rows that may be repeated are numbered anew, the others pass by
        classes = several.select(F.pmod("r_hash", F.lit(CLASSES)).alias("r_class")).distinct()
        flagged = own.withColumn("class", F.pmod("hash", F.lit(CLASSES))).join(F.broadcast(classes), F.col("class") == F.col("r_class"), "left")
        some = staged(flagged.filter(F.col("r_class").isNotNull()).select(*columns(own), F.spark_partition_id().alias("part")), "some")
        rest = flagged.filter(F.col("r_class").isNull()).select(*columns(own), F.lit(1).cast("long").alias("nth"))
        own = rest.unionByName(numbered(some, staged(repeats(some), "repeats")).drop("part"))
    own = own.withColumn("h", draw(F.col("doc_id"), F.col("hash"), F.col("nth"), seed))
    copies = (F.col("epochs") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)).cast("int")
    (copy,) = new_names([*own.columns, *p.columns], 1)
    return (
        by_source(own, "source", p, "p_source", F.col("h"))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*[F.col(a).alias(c) for a, c in names.items()])
    )


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || hash || ':' || row_number() OVER (PARTITION BY doc_id, hash, source)), 1, 15))::BIGINT AS h
  FROM (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS hash
    FROM documents)),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source),
fill(step, source, source_size, weight, capped, rest, weights) AS (
  SELECT 0, source, source_size, weight, false, (sum(source_size) OVER ())::BIGINT, (sum(weight) OVER ())::BIGINT FROM src
  UNION ALL
  SELECT step + 1, source, source_size, weight, now,
    ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) FILTER (now) OVER (), 0))::BIGINT,
    coalesce(sum(weight) FILTER (NOT now) OVER (), 0)::BIGINT
  FROM (SELECT *, capped OR rest::DOUBLE * weight / nullif(weights, 0) >= 3 * source_size AS now FROM fill)
  WHERE step < (SELECT count(*) FROM src)),
target AS (
  SELECT source, source_size,
    CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE least((3 * source_size)::DOUBLE, rest::DOUBLE * weight / weights) END AS target
  FROM fill WHERE step = (SELECT count(*) FROM src)),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS need
  FROM target),
cum AS (
  SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS done FROM sized GROUP BY source, h),
best AS (
  SELECT cum.source, h, abs(done - need) AS off FROM cum JOIN need ON cum.source IS NOT DISTINCT FROM need.source
  UNION ALL SELECT source, -1, need FROM need),
upto AS (SELECT source, arg_min(h, {"off": off, "h": h}) AS upto FROM best GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN h <= upto THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN need n ON s.source IS NOT DISTINCT FROM n.source JOIN upto u ON s.source IS NOT DISTINCT FROM u.source
"""
