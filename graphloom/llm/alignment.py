"""Alignment of two tokenizers over the same texts.

A text is encoded by a byte-level tokenizer A and a piece tokenizer B; both write the same bytes. The union of both sides' token
ends cuts the bytes into elementary intervals; searching the sorted ends gives each interval its owners, so each interval is one overlap
of an A token with a B token. Ends that both sides share close groups, and the product of a group's two sides expands to its links.

Which token pairs count as linked is a parameter: ``ends`` (their byte ranges end together), ``overlaps`` (their byte ranges meet) or
``groups`` (they stand in one group).

Texts are cut where both sides always have an end: before a blank or line break that follows anything but white space. A
segment's alignment doesn't depend on what stands around it, so a Python worker keeps those of many segments.

Corpus-wide counts: texts are put into blocks of bounded size. A block's distinct pairs are counted once, summed over all
blocks by pair, and come back to the block; so a pair that stands in every text is one row for each block.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .pieces import MARK
from .pieces import load as load_pieces

#: Fixed value: the public pattern by which byte-level tokenizers of this kind part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Segments whose alignments one Python worker keeps, and the longest of them; beyond it the oldest go.
CACHE_SEGMENTS, CACHE_LENGTH = 200_000, 64
#: Stretches that B's encoder keeps beside them: those of a kept segment are never asked for again.
CACHE_STRETCHES = 200_000
#: Characters of text that are aligned at once, and bytes of text in one block.
SLICE, BLOCK_BYTES = 1_500_000, 8 << 20
#: Token pairs of a group's product that are held at once.
PRODUCT = 1 << 20
LINKS = ("ends", "overlaps", "groups")
#: White space is what parts words in either tokenizer; a segment starts with a blank or a line break.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")


class Aligner:
    """Both tokenizers' tables."""

    def __init__(self, a_path: str, b_path: str, links: str):
        import tiktoken

        if links not in LINKS:
            raise ValueError(f"links is one of {LINKS}")
        self.links = links
        spec = json.load(open(a_path, encoding="utf-8"))
        kept = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else "" for b in range(256)]
        spare = iter(range(256, 512))
        byte_of = {c or chr(next(spare)): b for b, c in enumerate(kept)}
        added = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in added}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b, self.b_cache = load_pieces(b_path)
        a_bytes = {i: s for s, i in ranks.items()}
        self.a_bytes = np.array([a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)], dtype=object)
        self.b_bytes = np.array([bytes([self.b.byte_of[i]]) if i in self.b.byte_of else x.encode() for i, x in enumerate(self.b.pieces)], dtype=object)
        self.a_size, self.b_size = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        digits = [b"%d" % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        inner, last_a, last_b = (np.array([d + x for d in digits], dtype=object) for x in (b",", b"|", b";"))
        self.written = {(0, False): inner, (0, True): last_a, (1, False): inner, (1, True): last_b}
        self.width = np.array(list(map(len, digits)), dtype=np.int64) + 1
        self.cache: dict[str, tuple] = {}

    def align(self, segments: list[str]) -> dict[str, tuple]:
        """For each segment: groups as text, numbers of A tokens, B tokens and groups, and its links as numbers (A id, B id); () if a side writes it otherwise."""
        out: dict[str, tuple] = {}
        inner = []
        for s in segments:
            if MARK in s:  # B writes a blank
                out[s] = ()
            elif s[-1].isspace():  # it ends its text, and would be split otherwise if another followed
                out |= self._aligned([s])
            else:
                inner.append(s)
        return out | self._aligned(inner)

    def _aligned(self, segments: list[str]) -> dict[str, tuple]:
        """The same for segments that may stand one after the other: all are encoded and aligned at once."""
        if not segments:
            return {}
        joined = "".join(segments)
        raw = joined.encode()
        a = np.array(self.a.encode_ordinary(joined), dtype=np.int64)
        b = np.frombuffer(self.b.encode_marked([joined], self.b_cache, CACHE_STRETCHES)[0], dtype=np.int32).astype(np.int64)
        if b"".join(self.a_bytes[a].tolist()) != raw or b"".join(self.b_bytes[b].tolist()) != raw:
            half = len(segments) // 2
            return self._aligned(segments[:half]) | self._aligned(segments[half:]) if half else {segments[0]: ()}
        out: dict[str, tuple] = {}
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(a_ends, b_ends)  # elementary intervals, by their ends
        of_a, of_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)  # their owners
        closes = (a_ends[of_a] == ends) & (b_ends[of_b] == ends)
        shared = ends[closes]
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        # groups written one after the other, A's ids before B's
        key = np.concatenate([a_group * 2, b_group * 2 + 1])
        order = np.argsort(key, kind="stable")
        last = np.append(np.diff(key[order]) != 0, True)
        ids, side = np.concatenate([a, b])[order], key[order] & 1
        parts = np.where(side == 0, np.where(last, self.written[0, True][ids], self.written[0, False][ids]), np.where(last, self.written[1, True][ids], self.written[1, False][ids]))
        text, upto = b"".join(parts.tolist()), np.cumsum(self.width[ids])
        # segments end where both sides end
        seg_end = np.cumsum(list(map(len, segments)) if len(raw) == len(joined) else [len(s.encode()) for s in segments])
        n_a, n_b, n_g = (np.searchsorted(x, seg_end, side="right") for x in (a_ends, b_ends, shared))
        at = [0, *upto[n_a + n_b - 1].tolist()]
        pairs, pair_at = self._pairs(a, b, of_a, of_b, closes, a_group, b_group, ends, seg_end)
        n_a, n_b, n_g = (np.diff(x, prepend=0).tolist() for x in (n_a, n_b, n_g))
        for s, x, y, i, j, p, q in zip(segments, at, at[1:], n_a, n_b, pair_at, pair_at[1:]):  # noqa: B905
            out[s] = (text[x:y - 1], i, j, n_g[len(out)], pairs[p * 8:q * 8])
        return out

    def _pairs(self, a, b, of_a, of_b, closes, a_group, b_group, ends, seg_end) -> tuple[bytes, list[int]]:
        """All links in order as 64-bit numbers, and where each segment's begin."""
        if self.links != "groups":
            keep = closes if self.links == "ends" else np.ones(len(ends), dtype=bool)
            upto = np.searchsorted(ends[keep], seg_end, side="right")
            return (a[of_a[keep]] * len(self.b_bytes) + b[of_b[keep]]).tobytes(), [0, *upto.tolist()]
        first = np.searchsorted(b_group, np.arange(b_group[-1] + 2))  # where each group's B tokens begin
        many = np.diff(first)[a_group]
        out, row, total = [], 0, np.cumsum(many)
        while row < len(a):  # the products, some A tokens at a time
            end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PRODUCT, side="right")))
            n = many[row:end]
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a_group[row:end]], n)
            out.append((np.repeat(a[row:end], n) * len(self.b_bytes) + b[which]).tobytes())
            row = end
        ends_of_a = np.searchsorted(a_group, np.searchsorted(ends[closes], seg_end), side="right") - 1
        return b"".join(out), [0, *total[ends_of_a].tolist()]

    def texts(self, texts: list[str | None]) -> list[tuple | None]:
        """For each text the same as for a segment, links joined; None without tokens."""
        found = [_SEGMENT.findall(" " + x) if x else [] for x in texts]
        got = [list(map(self.cache.get, f)) for f in found]
        missing = [i for i, g in enumerate(got) if None in g]
        fresh = list({s for i in missing for s, r in zip(found[i], got[i], strict=True) if r is None})
        new = self.align(fresh) if fresh else {}
        for i in missing:
            got[i] = [new[s] if r is None else r for s, r in zip(found[i], got[i], strict=True)]
        self.cache.update((s, r) for s, r in new.items() if len(s) <= CACHE_LENGTH)
        for s in list(islice(self.cache, max(0, len(self.cache) - CACHE_SEGMENTS))):
            del self.cache[s]
        out: list[tuple | None] = []
        for g in got:
            if not g or not all(g):
                out.append(None)
            else:
                text, n_a, n_b, n_g, pairs = zip(*g)  # noqa: B905
                out.append((b";".join(text), sum(n_a), sum(n_b), sum(n_g), b"".join(pairs)))
        return out


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str, links: str) -> Aligner:
    """Once for a Python worker."""
    return Aligner(a_path, b_path, links)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of equal weight: what comes out is easier to compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def alignments(df: DataFrame, a_path: str, b_path: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups, block, pairs, times.

    ``groups`` is the alignment as text: ``a1,a2|b1;a3|b2,b3``, ids in order. ``pairs`` and ``times`` are the distinct linked id pairs (steps
    of A id x size of B + B id) and how often each stands, packed; ``block`` numbers blocks of texts of bounded size.

    Null and empty texts, and those that either tokenizer writes otherwise than they are, have no tokens: zeros and the empty text.
    Very long texts are aligned whole, segment by segment. Null and repeated ids and repeated rows each give their row; further columns are
    ignored, whatever their names. An empty table gives no rows. No shuffle.
    """
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    long = [StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    schema = StructType([rows.schema["doc_id"], *long, StructField("groups", StringType()), StructField("block", LongType()), StructField("pairs", BinaryType()), StructField("times", BinaryType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        aligner = load(a_path, b_path, links)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts, row = batch.column("text"), 0
            while row < batch.num_rows:
                own, size = [], 0
                while row + len(own) < batch.num_rows and (not own or size < SLICE):
                    own.append(texts[row + len(own)].as_py())
                    size += len(own[-1] or "")
                cols = [[], [], [], [], [], [], []]
                for got in aligner.texts(own):
                    if got is None:
                        values = (0, 0, 0, 0, "", b"", b"")
                    else:
                        text, n_a, n_b, n_g, raw = got
                        codes, times = np.unique(np.frombuffer(raw, dtype=np.int64), return_counts=True)
                        values = (n_a, n_b, n_g, len(raw) // 8, text.decode(), _packed(np.diff(codes, prepend=0)), _packed(times))
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                numbers = [pa.array(c, pa.int64()) for c in cols[:4]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(own)), *numbers, pa.array(cols[4], pa.string()), pa.array([block] * len(own), pa.int64()), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "pairs", "times"],
                )
                row, held = row + len(own), held + size
                if held > BLOCK_BYTES:
                    block, held = block + 1, 0

    return rows.mapInArrow(run, schema)


def _pairs_of(blocks, pairs, times):
    """block, pair and times of all rows of a batch, one after the other."""
    each = [np.cumsum(_unpacked(p).astype(np.int64)) for p in pairs]
    sizes = list(map(len, each))
    return np.repeat(blocks, sizes), np.concatenate([np.zeros(0, dtype=np.int64), *each]), np.concatenate([np.zeros(0, dtype=np.int64), *[_unpacked(t).astype(np.int64) for t in times]]), sizes


def block_pairs(aligned: DataFrame) -> DataFrame:
    """block, pair, n: how often a pair is linked in a block; a block that is read in pieces has a row for each."""

    def run(batches):
        import pyarrow as pa

        def rows(block, codes, n):
            found, which = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate(n), minlength=len(found)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found), pa.array(total)], ["block", "pair", "n"])

        block, codes, n, held = None, [], [], 0
        for batch in batches:
            blocks, every, times, _ = _pairs_of(batch.column("block").to_numpy(), batch.column("pairs").to_pylist(), batch.column("times").to_pylist())
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if codes and (blocks[a] != block or held > 4 * PRODUCT):
                    yield rows(block, codes, n)
                    codes, n, held = [], [], 0
                block = blocks[a]
                codes.append(every[a:b])
                n.append(times[a:b])
                held += b - a
        if codes:
            yield rows(block, codes, n)

    return aligned.select("block", "pairs", "times").mapInArrow(run, "block long, pair long, n long")


def correspondences(aligned: DataFrame, b_size: int) -> DataFrame:
    """a, b, n: how often each pair of ids is linked in all texts. ``b_size`` is the size of B's vocabulary."""
    total = block_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("n"))
    return total.select(F.floor(F.col("pair") / b_size).alias("a"), (F.col("pair") % b_size).alias("b"), "n")


def scored(df: DataFrame, a_path: str, b_path: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is linked as often as any pair of its B id, in all texts; count_sum: the counts of all links, added up.
    Odd rows: as :func:`alignments`; without tokens groups_sha256 is empty.
    """
    from sentencepiece import SentencePieceProcessor

    b_size = SentencePieceProcessor(model_file=b_path).get_piece_size()
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    held = staged(alignments(df, a_path, b_path, links, id_col, text_col).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counted = block_pairs(held).groupBy("block", "pair").agg(F.sum("n").alias("n"))
    counted = staged(counted.select("block", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("total")), "pair-counts")
    # one row for each B id: no more than its vocabulary
    best = counted.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("total").alias("most"))
    marked = counted.withColumn("b", F.col("pair") % b_size).join(F.broadcast(best), "b").select("block", "pair", "total", (F.col("total") == F.col("most")).alias("best"))
    return _looked_up(held, marked)


def _looked_up(held: DataFrame, marked: DataFrame) -> DataFrame:
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = StructType([held.schema["doc_id"], *[StructField(c, LongType()) for c in names], StructField("groups_sha256", StringType())])

    def run(left, right):
        import pyarrow as pa

        order = np.argsort(right.column("pair").to_numpy())
        known = right.column("pair").to_numpy()[order]
        total, best = right.column("total").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order] if right.num_rows else np.zeros(0, dtype=bool)
        _, codes, times, sizes = _pairs_of(left.column("block").to_numpy(), left.column("pairs").to_pylist(), left.column("times").to_pylist())
        at = np.searchsorted(known, codes)
        ends = np.cumsum([0, *sizes])
        sums = [np.diff(np.append(0, np.cumsum(x))[ends]) for x in (times * best[at], times * total[at])]
        return pa.table([left.column("doc_id"), *[left.column(c) for c in names[:4]], *[pa.array(x, pa.int64()) for x in sums], left.column("groups_sha256")], names=["doc_id", *names, "groups_sha256"])

    return held.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(run, schema)
