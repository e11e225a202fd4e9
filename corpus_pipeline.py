"""A corpus pipeline over ``documents``: quality, near copies, repeated passages, mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
folder and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, mixing, quality, substrings
from graphloom.llm.common import staged
from graphloom.llm.queries import word_bpe_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the cascade reject go: null, empty and very short texts too.

    Very long texts are judged whole; equal rows stay or go together. Ids, null or repeated, play no part. All columns
    stay, whatever their names; an empty table stays empty.
    """
    return quality.keep_clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over shingles of five words the smallest id stays.

    Null ids count as the largest; of equal ids the text of the smallest SHA-256, of rows equal in both one. Texts without
    words all stay; very long ones are compared whole. All columns stay, whatever their names; an empty table stays empty.
    """
    return jaccard.keep_one(docs, n=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 35 that stand anywhere else go; a document that loses all of them stays, empty.

    n_chars follows the text. Null, empty and short texts stay as they are; very long ones are read whole. Repeated rows and
    ids lose what they share. All columns stay, whatever their names; an empty table stays empty.
    """
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weights 1, 2, 3 of the sources, three epochs at most, ask for.

    What the mix takes no time is left out: that is the mix, not a filter. Null sources are one source; null and empty texts
    have no words and are drawn like others; null and repeated ids and repeated rows are each drawn by themselves. Very long texts
    count whole. All columns stay, whatever their names; an empty table stays empty.
    """
    return mixing.materialise(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids (little-endian unsigned 32-bit integers) and their SHA-256, one row for each row.

    Null and empty texts have no ids; very long ones are encoded whole. Null and repeated ids only name rows; further columns
    are left out. An empty table stays empty.
    """
    coded = bpe.encode(docs.select("doc_id", "source", "text"), word_bpe_path())
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: Not expressible in SQL (near copies, token ids); tests compare it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
