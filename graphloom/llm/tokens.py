"""Token ids in training order, as fixed-stride binary shards.

Each text becomes sequences of LENGTH token ids (its own ids, an end mark, padding). All sequences are numbered
densely; a keyed Feistel network permutes the numbers, walking along its cycles until a number lies in range,
so that every sequence has one global slot and every slot one sequence, whatever their count. Shard k holds the
slots from k * SHARD on, in order, each in STRIDE bytes: two for an id, little-endian, and a line feed. Slot s is at
byte (s mod SHARD) * STRIDE of its shard, so reading goes on from any slot without an index.

Texts are tokenised once, into a compressed table that is staged; ids travel in compressed blocks, one per task
and shard. Partition p of P gets the p-th range of slots, whole shards of it, and writes them one after another.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mix64, new_path, release, small_batches, text_of

LENGTH, SHARD = 128, 65_536
STRIDE = 2 * LENGTH + 1
ROUNDS = 6
#: Bytes of sequences that a task gathers before it sends its blocks.
GATHER = 8 << 20
#: Compression of the staged ids, and of the blocks that travel.
STAGED_LEVEL, BLOCK_LEVEL = 5, 3
#: Most partitions that slots are dealt to; beyond, each writes several shards.
MOST_RANGES = 20_000


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot, below n, of each index below n: a bijection for every n and key."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        x = out[left]
        a, b = x >> half, x & mask
        for r in range(ROUNDS):
            a, b = b, a ^ (mix64(b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) & mask)
        out[left] = (a << half) | b
        left = left[out[left] >= n]
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sequences(ids: np.ndarray, counts: np.ndarray, end: int, length: int = LENGTH) -> np.ndarray:
    """The ids of texts that have ``counts`` of them, each text's followed by an end mark, in rows of ``length``.

    Every text begins a row; its last row is filled up with end marks.
    """
    many = -(-(counts + 1) // length)
    out = np.full(int(many.sum()) * length, end, dtype="<u2")
    shift = (np.cumsum(many) - many) * length - (np.cumsum(counts) - counts)
    out[np.arange(len(ids)) + np.repeat(shift, counts)] = ids
    return out.reshape(-1, length)


def _fixed(rows: np.ndarray, width: int):
    """The rows of an array, ``width`` bytes each, as a binary column."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _tokenised(rows: DataFrame, path: str, pattern: str, end: int, length: int) -> DataFrame:
    """For each batch of rows: id and n_tokens lists, all their ids (compressed), part (the task), before and after.

    before, after: the sequences that the task has made up to this batch and with it.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, before, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=STAGED_LEVEL)
        coder = encoding(path, pattern)
        for batch in batches:
            found = [coder.encode_to_numpy(x, disallowed_special=()) for x in batch.column("text").to_pylist()]
            if not found:
                continue
            count, every = [len(x) for x in found], np.concatenate(found)
            if len(every) and int(every.max()) > 0xFFFF:
                raise ValueError("an id doesn't fit into two bytes")
            after = before + sum(-(-(n + 1) // length) for n in count)
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([count], pa.list_(pa.int64())), pa.array([pack.compress(every.astype("<u2").tobytes())], pa.binary()),
                    pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([after], pa.int64()),
                ],
                ["id", "n_tokens", "ids", "part", "before", "after"],
            )
            before = after

    return rows.mapInArrow(run, f"id array<{kind}>, n_tokens array<long>, ids binary, part int, before long, after long")


def write(df: DataFrame, out: str, path: str, pattern: str, end: int = 50_256, key: int = 23, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write all shards under ``out``; gives the index: doc_id, seq, slot, shard, n_tokens (ids of the text in this sequence).

    ``path`` is a rank file of ids below ``end`` (65,536 at most), ``pattern`` its splitting expression. A null text
    counts as empty: one sequence of end marks. Repeated rows and ids are sequences of their own. An empty table
    writes nothing. The staged table is read in the order of its tasks' numbering, so a task that is run anew gives
    the same slots.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    staged_path = new_path(spark, "tokens")
    with small_batches(spark):
        _tokenised(rows, path, pattern, end, length).write.option("compression", "uncompressed").parquet(staged_path)
    held = spark.read.parquet(staged_path)
    totals = held.groupBy("part").agg(F.max("after").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for r in totals:  # one number a task
        base[r["part"]] = total
        total += r["n"]

    def place(batches):
        import pyarrow as pa
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=BLOCK_LEVEL)
        slots, bodies, size = [], [], 0

        def blocks():
            slot, body = np.concatenate(slots), np.concatenate(bodies)
            order = np.argsort(slot)
            of = slot[order] // shard
            groups = np.split(order, np.flatnonzero(np.diff(of)) + 1)
            steps = [np.diff(slot[g], prepend=slot[g[0]] // shard * shard).astype("<u4") for g in groups]
            data = [pack.compress(x.tobytes() + body[g].tobytes()) for x, g in zip(steps, groups, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([int(slot[g[0]]) // shard for g in groups], pa.int64()), pa.array([len(g) for g in groups], pa.int64()), pa.array(data, pa.binary())], ["shard", "n", "block"])

        for batch in batches:
            for ids, counts, part, at in zip(*(batch.column(c).to_pylist() for c in ("ids", "n_tokens", "part", "before")), strict=True):
                every = np.frombuffer(unpack.decompress(ids, max_output_size=2 * sum(counts) + 16), "<u2")
                rows = sequences(every, np.array(counts, dtype=np.int64), end, length)
                slots.append(permute(base[part] + at + np.arange(len(rows)), total, key))
                bodies.append(rows)
                size += rows.nbytes
                if size > GATHER:
                    yield blocks()
                    slots, bodies, size = [], [], 0
        if slots:
            yield blocks()

    def fill(batches):
        import pyarrow as pa
        import zstandard

        unpack, width = zstandard.ZstdDecompressor(), 2 * length

        def whole(of, slots, bodies):
            slot, body = np.concatenate(slots), np.concatenate(bodies)
            order = np.argsort(slot)
            value = _fixed(np.ascontiguousarray(body[order]), width)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(order), of)), pa.array(slot[order]), value], ["shard", "slot", "value"])

        open_, slots, bodies = None, [], []
        for batch in batches:
            for of, n, block in zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if of != open_ and slots:
                    yield whole(open_, slots, bodies)
                    slots, bodies = [], []
                raw = unpack.decompress(block, max_output_size=n * (4 + width) + 16)
                open_ = of
                slots.append(of * shard + np.cumsum(np.frombuffer(raw[: 4 * n], "<u4"), dtype=np.int64))
                bodies.append(np.frombuffer(raw[4 * n:], "<u2").reshape(n, length))
        if slots:
            yield whole(open_, slots, bodies)

    shards = -(-total // shard)
    ranges = max(1, min(shards, MOST_RANGES))
    blocks = held.select("id", "n_tokens", "ids", "part", "before").mapInArrow(place, "shard long, n long, block binary")
    dealt = blocks.repartitionById(ranges, F.floor(F.col("shard") * ranges / max(1, shards)).cast("int")).sortWithinPartitions("shard")
    filled = dealt.mapInArrow(fill, "shard long, slot long, value binary")
    if total:
        with small_batches(spark):
            (
                filled.select("shard", F.col("value").cast("string").alias("value"))
                .write.option("lineSep", "\n").partitionBy("shard").text(out)
            )
    del blocks, dealt, filled
    release(spark)
    index = _index(held, base, total, key, length, shard)
    index.write.parquet(f"{out}-index")
    discard(held)
    release(spark)
    return spark.read.schema(index.schema).parquet(f"{out}-index")


def _index(held: DataFrame, base: dict, total: int, key: int, length: int, shard: int) -> DataFrame:
    kind = held.schema["id"].dataType.elementType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, counts, part, before in zip(batch.column("id"), batch.column("n_tokens").to_pylist(), batch.column("part").to_pylist(), batch.column("before").to_pylist(), strict=True):
                n = np.array(counts, dtype=np.int64)
                many = -(-(n + 1) // length)
                row = np.repeat(np.arange(len(n)), many)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                slot = permute(base[part] + before + np.arange(len(row)), total, key)
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(row)), pa.array(seq), pa.array(slot), pa.array(slot // shard), pa.array(np.clip(n[row] - seq * length, 0, length))], ["doc_id", "seq", "slot", "shard", "n_tokens"])

    return held.select("id", "n_tokens", "part", "before").mapInArrow(run, f"doc_id {kind}, seq long, slot long, shard long, n_tokens long")


def read(spark: SparkSession, out: str, first_slot: int = 0, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """slot and ids (two bytes each, little-endian) of the shards under ``out``, from ``first_slot`` on: earlier shards aren't opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(out).select("shard", "content").filter(F.col("shard") >= first_slot // shard)
    stride = 2 * length + 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if raw.size % stride:
                    raise ValueError(f"shard {k} isn't a whole number of sequences")
                table = np.frombuffer(raw, np.uint8).reshape(-1, stride)
                if (table[:, -1] != 10).any():
                    raise ValueError(f"shard {k} is out of step")
                at = max(0, first_slot - k * shard)
                for a in range(at, len(table), 8_192):
                    body = np.ascontiguousarray(table[a:a + 8_192, :-1])
                    yield pa.RecordBatch.from_arrays([pa.array(k * shard + a + np.arange(len(body))), _fixed(body, 2 * length)], ["slot", "ids"])

    return files.mapInArrow(run, "slot long, ids binary")


def materialise(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write the shards into the shared folder, read them back: doc_id, seq, slot, shard, n_tokens and ids_sha256 of each sequence.

    Null, empty and very long texts, repeated rows and ids, and an empty table are as in :func:`write`; further columns
    of any name are ignored. Slots have no ties.
    """
    spark = df.sparkSession
    out = new_path(spark, "shards")
    index = write(df, out, path, pattern, id_col=id_col, text_col=text_col, length=length, shard=shard)
    if index.isEmpty():
        return index.withColumn("ids_sha256", F.lit(None).cast("string"))
    found = read(spark, out, length=length, shard=shard).select("slot", F.sha2("ids", 256).alias("ids_sha256"))
    return index.join(found, "slot").select("doc_id", "seq", "slot", "shard", "n_tokens", "ids_sha256")
