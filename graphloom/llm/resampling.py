"""Importance resampling towards a target distribution of hashed word features.

Features of a text are its runs of one to ``longest`` words, counted in buckets of a fixed hash. The logarithm of how much more frequent a bucket is
in the target than in the corpus is its gain, a whole number of thousandths; a document's weight is the floored mean of its features' gains, and
its score adds Gumbel noise that its id alone decides. The highest scores are a draw without replacement in proportion to the weights.

Scores are whole numbers, so the draw needs no sort of all rows: an exact histogram counts the documents of each score, counts summed from the
highest score down are the offsets of ranks, and the score at which the wanted number is reached is the cutoff. Within each
score that survives rows are numbered by id. Rows alike in all that is returned are counted before, and take that many numbers.

Bounds: buckets are a fixed number of counters, and gains one number each; the histogram has a row for each whole score, of which the logarithms of
corpus sizes and 32 bits of noise allow some 100,000 (:data:`MOST_SCORES`).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: One word: a run of letters, digits and characters beyond ASCII.
FEATURE_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Gains and scores are thousandths.
SCALE = 1000
#: Whole scores that there can be: gains are logarithms of counts below 2^63, noise of 32 bits.
MOST_SCORES = 4 * 64 * SCALE
#: Features that are gathered before they are counted.
HELD = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def features(text: str | None, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each of its features.

    A run's CRC-32 goes on from that of the run without its last word.
    """
    words = re.findall(FEATURE_WORD, text.encode().translate(_LOWER)) if text else []
    if not words:
        return 0, np.zeros(0, dtype=np.int64)
    runs = list(map(zlib.crc32, words))
    out, later = [runs], [b" " + w for w in words]
    for n in range(1, min(longest, len(words))):
        runs = list(map(zlib.crc32, later[n:], runs))
        out.append(runs)
    return len(words), np.concatenate([np.array(r, dtype=np.int64) for r in out]) % buckets


def bucket_counts(df: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket occurs in all texts: each task counts its own, a fixed number of counters, which are then summed by bucket."""

    def run(batches):
        import pyarrow as pa

        total, held, size = np.zeros(buckets, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(features(text.as_py(), buckets, longest)[1])
                size += len(held[-1])
                if size > HELD:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # one row for each bucket
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) for each bucket."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * float(s_all + size) / ((s + 1.0) * float(t_all + size))
    return np.array([math.floor(SCALE * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(seed: int, name: str) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(df: DataFrame, gain: np.ndarray, seed: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_features, weight, score, n_words of each row."""
    from pyspark.sql.types import LongType, StructField, StructType

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"))
    sent = df.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches):
        import pyarrow as pa

        own = sent.value
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for text, name in zip(batch.column("text"), batch.column("name").to_pylist(), strict=True):
                n, found = features(text.as_py(), len(own), longest)
                weight = int(own[found].sum()) // len(found) if len(found) else 0
                for column, value in zip(out, (len(found), weight, weight + noise(seed, name), n), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out]], ["doc_id", "n_features", "weight", "score", "n_words"])

    schema = StructType([rows.schema["doc_id"], *[StructField(c, LongType()) for c in ("n_features", "weight", "score", "n_words")]])
    return rows.mapInArrow(run, schema)


def resampled(
    df: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, seed: int = 7, least_words: int = 20, percent: int = 25,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; of the rows with ``least_words`` words ``percent`` in a hundred are drawn.

    Ranks go by score, then by smaller id, from 1 without gaps; rows that aren't drawn have none. Null and empty texts have no
    features, weight 0, and aren't drawn. A null id counts as the largest, its noise is that of the empty name. Repeated ids and repeated
    rows are each drawn by themselves; of equal scores and ids the row of fewer features, then of the smaller weight, comes first. Very long texts
    count whole. Further columns are ignored, whatever their names. Empty tables give no rows; an empty target has no feature anywhere.
    """
    gain = gains(bucket_counts(df, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    rows = staged(weighed(df, gain, seed, longest, id_col, text_col), "scores")
    enough = F.col("n_words") >= least_words
    histogram = rows.filter(enough).groupBy("score").count().collect()  # one row for each whole score
    if len(histogram) > MOST_SCORES:
        raise ValueError("more scores than there can be")
    score = np.array(sorted((r["score"] for r in histogram), reverse=True), dtype=np.int64)
    count_of = {r["score"]: r["count"] for r in histogram}
    upto = np.cumsum([count_of[int(s)] for s in score], dtype=np.int64)
    wanted = int(upto[-1]) * percent // 100 if len(upto) else 0
    surviving = int(np.searchsorted(upto, wanted)) + 1 if wanted else 0
    none = F.lit(None).cast("long")
    if not surviving:
        return rows.select("doc_id", "n_features", "weight", "score", none.alias("rank"))
    cutoff = int(score[surviving - 1])
    offsets = df.sparkSession.createDataFrame([(int(s), int(n) - count_of[int(s)]) for s, n in zip(score[:surviving], upto, strict=False)], "score long, above long")
    drawn = enough & (F.col("score") >= cutoff)
    alike = rows.filter(drawn).groupBy("score", "doc_id", "n_features", "weight").agg(F.count("*").alias("n"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    # without repeated rows this is row_number
    placed = alike.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.join(F.broadcast(offsets), "score").withColumn("first", F.col("above") + F.coalesce("before", F.lit(0)))
    ranked = placed.withColumn("rank", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("n"))))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rows.filter(~drawn).select("doc_id", "n_features", "weight", "score", none.alias("rank")))
