"""Pieces that several operators share: word patterns, staged tables, numpy word hashing."""

from __future__ import annotations

import gc
import time
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import shared_folder

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one numpy pass works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch that is written to a staged table.
BATCH_ROWS = 1_000


def text_of(column: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of whole texts are held twice, in the JVM and in Python: fewer rows each bound their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before) or BATCH_ROWS, BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def partitions_at_least(spark: SparkSession, count: int):
    """Shuffles of so many partitions at least, where they have to be small enough for one file each."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), count)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, outlives any executor."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that was written to one folder, once later tables hold all that is still needed of it.

    This and :func:`release` are the only places that reach through to the JVM: PySpark has no call that deletes a
    path of any file system, nor one that drops the shuffle files of a finished plan.
    """
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans: it does so when the driver's objects are collected.

    Only called after the large shuffles. The pauses give the threads that drop references and delete files, on either
    side, the time to do so.
    """
    gc.collect()
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.7)


def text_key(text: Column | str) -> Column:
    """Names a text: its SHA-256, so that equal keys are equal texts."""
    return F.unhex(F.sha2(F.col(text) if isinstance(text, str) else text, 256))


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def new_names(taken, count: int) -> list[str]:
    """Column names that none of the taken ones begins with, whatever their case."""
    taken, n = [c.lower() for c in taken], 0
    while any(c.startswith(f"_c{n}_") for c in taken):
        n += 1
    return [f"_c{n}_{i}" for i in range(count)]


def rows_among(keys: DataFrame):
    """A function of xxhash64 of a key: false only if that isn't one of ``keys`` (one column).

    It tests a bit field of fixed size, FILTER_BITS; where many keys fill it, it only lets more through.
    """
    spark = keys.sparkSession
    bits = spark.sparkContext.broadcast(bit_field(keys.select(F.xxhash64(keys.columns[0]).alias("h"))))

    @F.arrow_udf("boolean")
    def may_be(h):
        import pyarrow as pa

        h, field = h.to_numpy().view(np.uint64), bits.value
        a, b = ((x & np.uint64(FILTER_BITS - 1)).astype(np.int64) for x in (h, h >> np.uint64(32)))
        return pa.array((field[a >> 3] >> (a & 7) & 1 & (field[b >> 3] >> (b & 7))).astype(bool))

    return may_be


def one_row_each(rows: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """Staged: the row of ``rows`` (id, tid, text) that ``wanted`` (p_id, p_tid and more) names, once for each ``key``.

    Most rows are wanted by nobody: a bit field keeps most of their texts out of the shuffle, what it lets through is
    joined exactly.
    """
    more = [c for c in wanted.columns if c not in ("p_id", "p_tid")]
    found = (
        rows.withColumn("_h", F.xxhash64("tid")).filter(rows_among(wanted.select("p_tid"))("_h")).drop("_h")
        .join(wanted, (F.col("tid") == F.col("p_tid")) & F.col("id").eqNullSafe(F.col("p_id")))
        .select(*dict.fromkeys([key, "text", *more]))
    )
    held = staged(found, name)
    if held.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return held
    single = staged(held.dropDuplicates([key]), name)  # rows that repeat both id and text
    discard(held)
    return single


#: Bits of the field (2 MB), and the pieces that it is put together from.
FILTER_BITS, FILTER_PARTS = 1 << 24, 32


def bit_field(keys: DataFrame) -> np.ndarray:
    """Two bits set for each 64-bit hash ``h``, united on the executors piece by piece."""

    def local(batches):
        import zlib

        import pyarrow as pa

        field = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            for x in (h, h >> np.uint64(32)):
                field[(x & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        parts = np.packbits(field, bitorder="little").reshape(FILTER_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(FILTER_PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["part", "bits"])

    def unite(group, found):
        import zlib

        import pyarrow as pa

        total = np.zeros(FILTER_BITS // 8 // FILTER_PARTS, dtype=np.uint8)
        for x in found.column("bits").to_pylist():
            total |= np.frombuffer(zlib.decompress(x), dtype=np.uint8)
        return pa.table({"part": pa.array([group[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((FILTER_PARTS, FILTER_BITS // 8 // FILTER_PARTS), dtype=np.uint8)
    for r in keys.mapInArrow(local, "part int, bits binary").groupBy("part").applyInArrow(unite, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- word hashing over raw UTF-8 ---------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for each byte value, so that the hash isn't linear in the bytes.
_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a buffer of bytes."""
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_IS_SPACE[raw], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words wherever they stand.

    Each byte is replaced by a random number and weighted by its place in its word;
    the sum over the word is then finalised. Vectorised: no Python step per word.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    at = np.arange(len(raw), dtype=np.int64)
    first = np.zeros(len(raw), dtype=np.int64)
    first[starts[1:]] = starts[1:] - starts[:-1]
    place = at - (np.cumsum(first) + starts[0])
    code = _BYTE[_LOWER[raw]] if lower else _BYTE[raw]
    code = (code ^ (place.astype(np.uint64) * _M2)) * (_ODD + (place.astype(np.uint64) << np.uint64(1)))
    code ^= code >> np.uint64(29)
    code *= _M1
    total = np.add.reduceat(code, np.stack([starts, np.minimum(ends, len(raw) - 1)], 1).ravel())[::2]
    if ends[-1] == len(raw):  # reduceat can't be told of an end beyond the buffer
        total[-1] = np.add.reduce(code[starts[-1]:])
    return mix64(total + lens.astype(np.uint64) * _ODD)


def ngram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words, from the words' hashes; order matters."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64((seed * 0x2545F4914F6CDD1D + n) & 0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        for k in range(n):
            h = (h ^ words[k:k + m]) * _M1
            h ^= h >> np.uint64(32)
    return mix64(h)


def text_slices(column, limit: int = SLICE_BYTES):
    """Cut a string column of Arrow into runs of rows of about ``limit`` bytes (one row at least).

    Yields (first row, number of rows, bytes of the run as uint8, row offsets within them); null is empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end - row, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words_by_row(raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Word hashes of a run of rows and each row's bounds in them; a word never crosses rows."""
    sep = np.insert(raw, offsets[1:-1], 32) if len(offsets) > 2 else raw
    begin = offsets[:-1] + np.arange(len(offsets) - 1)
    starts, ends = word_spans(sep)
    bounds = np.append(np.searchsorted(starts, begin), len(starts))
    return word_hashes(sep, starts, ends, lower), bounds, starts, ends, sep
