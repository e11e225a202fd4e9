"""Substring deduplication by compaction of a de Bruijn graph of words.

Edges are runs of ``window`` words, nodes the runs of one word less between two edges. An edge that stands
at two places or more is repeated. Repeated edges that always follow one another form a nonbranching path;
the places of an edge meet in one shuffle, learn there whether its neighbours are the same everywhere, and go back to
their texts, where such paths are compacted. A path's places, its source
coordinates, are then read again in the texts, and count only if the very same words stand at two of them.

Edges whose minimizer stands at very many places, and the places of an edge beyond a number, take no part in
that: they stay paths of one edge at all their places alike, which are verified like any other. So no edge is a hot key.

Most windows stand once. A window is only made an edge if its minimizer (the smallest hash among its runs of
``seed`` words, the same wherever the window stands) is itself repeated, which every repeated window's is; so
about one row in fourteen words is shuffled to find the rest. Equal texts, by their SHA-256, are one class
throughout; only the rows of minimizers name a text by 64 bits of it, each text's candidates being all of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, columns, discard, new_names, ngram_hashes, one_row_each, release, rows_among, staged, text_key, text_of, text_slices, words_by_row

WINDOW, SEED = 35, 8
#: Places of a minimizer, and of an edge, from which on edges aren't compacted; bounds what one task has to read or hold of one.
HOT_SEED, HOT_EDGE = 20_000, 100_000


def minimizer_runs(words: np.ndarray, bounds: np.ndarray, window: int, seed: int):
    """Runs of windows with one minimizer: (row, first window, last window, hash), windows counted within the row."""
    n, none = len(words), np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64)
    grams = ngram_hashes(words, seed)
    width, at = window - seed + 1, np.arange(n - window + 1)
    place = at + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    row = np.searchsorted(bounds[1:], at, side="right")
    inside = at + window <= bounds[1:][row]
    at, place, row = at[inside], place[inside], row[inside]
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[new[1:] - 1, len(at) - 1]
    first_of = bounds[row[new]]
    return row[new], at[new] - first_of, at[last] - first_of, grams[place[new]]


def _minimizers(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """m, th, first, last for the distinct texts of each task. ``rows``: th, text."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            names = batch.column("th").to_numpy()
            for at, count, raw, offsets in text_slices(batch.column("text")):
                words, bounds, *_ = words_by_row(raw, offsets)
                row, first, last, m = minimizer_runs(words, bounds, window, seed)
                fresh = np.zeros(count, dtype=bool)
                for i, t in enumerate(names[at:at + count].tolist()):
                    if t not in seen:
                        fresh[i] = True
                        if len(seen) < 200_000:
                            seen.add(t)
                keep = fresh[row]
                row, first, last, m = row[keep], first[keep], last[keep], m[keep]
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int64)), pa.array(names[at:at + count][row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["m", "th", "first", "last"])

    return rows.mapInArrow(run, "m long, th long, first int, last int")


def _edges(texts: DataFrame, window: int) -> DataFrame:
    """h, doc, pos, next, prev for each candidate window; next and prev only where the neighbour is a candidate too.

    h is null for a window of a hot minimizer, which depends on the window's words alone.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            docs, runs = batch.column("doc").to_pylist(), batch.column("runs")
            for at, count, raw, offsets in text_slices(batch.column("text")):
                words, bounds, *_ = words_by_row(raw, offsets)
                out = [[], [], [], [], []]
                for i in range(count):
                    w = words[bounds[i]:bounds[i + 1]]
                    hit, hot = np.zeros((2, max(len(w) - window + 1, 0)), dtype=bool)
                    for r in runs[at + i].as_py():
                        hit[r["first"]:r["last"] + 1] = True
                        if r["hot"]:
                            hot[r["first"]:r["last"] + 1] = True
                    pos = np.flatnonzero(hit)
                    if not len(pos):
                        continue
                    h = ngram_hashes(w, window, seed=3).astype(np.int64)
                    wide = np.r_[False, hit, False]
                    out[0].append((h[pos], hot[pos]))
                    out[1].append(np.full(len(pos), docs[at + i], dtype=np.int64))
                    out[2].append(pos.astype(np.int32))
                    out[3].append((h[np.minimum(pos + 1, len(h) - 1)], ~wide[pos + 2]))
                    out[4].append((h[np.maximum(pos - 1, 0)], ~wide[pos]))
                if out[1]:
                    some = lambda x: pa.array(np.concatenate([v for v, _ in x]), mask=np.concatenate([k for _, k in x]))
                    yield pa.RecordBatch.from_arrays([some(out[0]), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])), some(out[3]), some(out[4])], ["h", "doc", "pos", "next", "prev"])

    return texts.select("doc", "text", "runs").mapInArrow(run, "h long, doc long, pos int, next long, prev long")


def _places(edges: DataFrame) -> DataFrame:
    """doc, pos, alone_out, alone_in for each place of a repeated edge: whether the edge after it, and before it, is the same at all places.

    ``edges`` comes in order of h, all places of an edge in one task. They are held until they end or are HOT_EDGE; from
    then on they are known to be branching, and pass by.
    """
    names = ["h", "doc", "pos", "next", "prev"]

    def run(batches):
        import pyarrow as pa

        def columns(batch):
            out = [batch.column(c) for c in names]
            return [x.fill_null(0).to_numpy() for x in out] + [x.is_valid().to_numpy(zero_copy_only=False) for x in out[3:]]

        def told(doc, pos, out_ok, in_ok):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(out_ok), pa.array(in_ok)], ["doc", "pos", "alone_out", "alone_in"])

        def whole(cols):
            """The rows of edges that are all here."""
            h = cols[0]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[start, len(h)])
            flags = []
            for value, known in ((cols[3], cols[5]), (cols[4], cols[6])):
                same = np.minimum.reduceat(value, start) == np.maximum.reduceat(value, start)
                flags.append(np.repeat(same & np.logical_and.reduceat(known, start), count))
            keep = np.repeat(count, count) > 1
            return told(cols[1][keep], cols[2][keep], flags[0][keep], flags[1][keep])

        held, branching = None, None  # the open edge's rows; the edge that is known to have HOT_EDGE places
        for batch in batches:
            cols = columns(batch)
            if not len(cols[0]):
                continue
            if branching is not None:
                same = cols[0] == branching
                if same.any():
                    no = np.zeros(int(same.sum()), dtype=bool)
                    yield told(cols[1][same], cols[2][same], no, no)
                    cols = [x[~same] for x in cols]
                    if not len(cols[0]):
                        continue
                branching = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if last:
                yield whole([x[:last] for x in cols])
            held = [x[last:] for x in cols]
            if len(held[0]) >= HOT_EDGE:
                branching, no = held[0][0], np.zeros(len(held[0]), dtype=bool)
                yield told(held[1], held[2], no, no)
                held = None
        if held is not None:
            yield whole(held)

    return edges.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, pos int, alone_out boolean, alone_in boolean")


def _paths(places: DataFrame) -> DataFrame:
    """doc, first, count: the compacted paths. ``places``: doc, pos, alone_out, alone_in, in order of doc and pos."""

    def run(batches):
        import pyarrow as pa

        held = None  # the path that is still open: doc, first, last, whether it may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, pos = batch.column("doc").to_numpy(), batch.column("pos").to_numpy()
            out_ok, in_ok = (np.array(batch.column(c).to_pylist(), dtype=bool) for c in ("alone_out", "alone_in"))
            goes = np.zeros(len(doc), dtype=bool)
            goes[1:] = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & out_ok[:-1] & in_ok[1:]
            if held:
                goes[0] = held[0] == doc[0] and held[2] + 1 == pos[0] and held[3] and bool(in_ok[0])
            start = np.flatnonzero(~goes)
            ends = np.r_[start[1:] - 1, len(doc) - 1] if len(start) else np.zeros(0, dtype=np.int64)
            docs, first, last = doc[start], pos[start], pos[ends] if len(start) else pos[:0]
            done = []
            if held:
                stretch = int(start[0]) if len(start) else len(doc)
                held = (held[0], held[1], int(pos[stretch - 1]) if stretch else held[2], bool(out_ok[stretch - 1]) if stretch else held[3])
                if len(start):
                    done.append(held)
            rows = [(int(a), int(b), int(c)) for a, b, c in zip(docs, first, last, strict=True)]
            if rows:
                held = (*rows[-1], bool(out_ok[-1]))
            rows = [x[:3] for x in done] + rows[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] - r[1] + 1 for r in rows], pa.int32())], ["doc", "first", "count"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array([held[2] - held[1] + 1], pa.int32())], ["doc", "first", "count"])

    return places.mapInArrow(run, "doc long, first int, count int")


def _read_spans(texts: DataFrame, window: int) -> DataFrame:
    """doc, first, count, digest of the words that stand at each span. ``texts``: doc, text, spans."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for doc, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split()
                for s in spans.as_py():
                    body = b" ".join(words[s["first"]:s["first"] + s["count"] + window - 1])
                    for column, v in zip(out, (doc, s["first"], s["count"], hashlib.blake2b(body, digest_size=16).digest()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["doc", "first", "count", "digest"])

    return texts.mapInArrow(run, "doc long, first int, count int, digest binary")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """tid, n_removed, kept: the texts without the words of their spans. ``texts``: tid, text, spans."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words), dtype=bool)
                for s in spans.as_py():
                    gone[s["first"]:s["first"] + s["count"] + window - 1] = True
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["tid", "n_removed", "kept"])

    return texts.mapInArrow(run, "tid binary, n_removed long, kept string")


def repeated_spans(rows: DataFrame, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): candidate texts (doc, tid, text), and verified spans (doc, first, count windows, digest).

    ``rows``: id, tid, text. Texts that stand in several rows take part once.
    """
    spark = rows.sparkSession
    pick = rows.groupBy("tid").agg(F.min("id").alias("p_id"))
    found = staged(_minimizers(rows.select(F.xxhash64("tid").alias("th"), "text"), window, seed).groupBy("m", "th", "first").agg(F.max("last").alias("last")), "minimizers")
    release(spark)
    # Written first, so that the join is of two plain tables and a frequent minimizer is more than one task.
    again = staged(found.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "again")
    hot = (F.col("n") > HOT_SEED).alias("hot")
    runs = found.join(again, "m").groupBy("th").agg(F.collect_list(F.struct("first", "last", hot)).alias("runs"))
    wanted = runs.join(pick.withColumn("th", F.xxhash64("tid")), "th").select(F.col("tid").alias("p_tid"), "p_id", "runs")
    wanted = staged(wanted.withColumn("doc", F.monotonically_increasing_id()).withColumn("class", F.col("p_tid")), "wanted")
    any_hot = not again.filter(F.col("n") > HOT_SEED).isEmpty()
    discard(found)
    discard(again)
    release(spark)
    texts = one_row_each(rows, wanted, "doc", "texts").withColumnRenamed("class", "tid")
    discard(wanted)
    release(spark)
    edges = _edges(texts, window)
    if any_hot:  # the texts are read twice rather than the edges written
        no = F.lit(False)
        places = _places(edges.filter(F.col("h").isNotNull())).unionByName(edges.filter(F.col("h").isNull()).select("doc", "pos", no.alias("alone_out"), no.alias("alone_in")))
    else:
        places = _places(edges)
    spans = staged(_paths(places.repartition("doc").sortWithinPartitions("doc", "pos")), "paths")
    release(spark)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    read = staged(_read_spans(texts.select("doc", "text").join(by_doc, "doc"), window), "spans")
    release(spark)
    # Written first, like the minimizers that stand again: a passage of very many places is more than one task.
    same = staged(read.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("digest"), "same")
    return texts, read.join(same, "digest")


def _classes(df: DataFrame, id_col: str, text_col: str, window: int):
    """(rows, plain, multi): rows with text and its class; their counts and digests without text; classes of several rows."""
    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("tid", text_key("text"))
    whole = F.trim(F.regexp_replace("text", f"{SPACE}+", " "))
    plain = staged(
        rows.select("id", "tid", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("n_words"), F.sha2(whole.cast("binary"), 256).alias("whole_sha256")),
        "plain",
    )
    multi = plain.filter(F.col("n_words") >= window).groupBy("tid").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("tid", F.lit(True).alias("copied"))
    return rows, plain, staged(multi, "multi")


def _kept(rows: DataFrame, window: int, seed: int) -> DataFrame:
    texts, spans = repeated_spans(rows, window, seed)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    return staged(_cut(texts.select("doc", "tid", "text").join(by_doc, "doc").select("tid", "text", "spans"), window), "kept")


def substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space).

    Null and empty texts have no words. A text shorter than a window loses nothing; very long ones are read whole. Repeated rows, and equal
    texts under any ids, each stand somewhere else: every window of theirs is repeated, so all their words
    go. Ids only name rows; null and repeated ids are fine. An empty table gives no rows.
    """
    rows, plain, multi = _classes(df, id_col, text_col, window)
    cut = _kept(rows, window, seed).select("tid", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        plain.join(multi, "tid", "left").join(cut, "tid", "left")
        .select(
            F.col("id").alias("doc_id"), "n_words",
            F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        )
    )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``df`` with the repeated words cut from its texts; a text that loses nothing stays as it is, to the byte.

    A text that loses words becomes its kept words joined by one space; a document that loses all keeps its row
    with an empty text, as does each of several rows of one text. Null and empty texts and those shorter than a window
    stay; very long ones are read whole. Ids only name rows. All rows and columns stay, whatever their names. An empty
    table gives no rows.

    Only rows that may lose words are shuffled: a bit field of their texts lets the others through.
    """
    rows, plain, multi = _classes(df, id_col, text_col, window)
    discard(plain)
    key, flag, kept, tid = new_names(df.columns, 4)
    cut = _kept(rows, window, seed)
    marks = cut.join(multi, "tid", "left_anti").select("tid", "kept").unionByName(multi.select("tid", F.lit("").alias("kept")))
    marks = staged(marks.select(F.col("tid").alias(tid), F.col("kept").alias(kept)), "marks")
    discard(cut)
    discard(multi)
    marked = df.withColumn(key, text_key(text_of(text_col)))
    marked = marked.withColumn(flag, rows_among(marks.select(tid))(F.xxhash64(key)))
    clear = marked.filter(~F.col(flag)).select(*columns(df))
    held = marked.filter(flag).join(marks, F.col(key) == F.col(tid), "left")
    new = F.coalesce(F.col(kept), F.col(f"`{text_col}`")).alias(text_col)
    return clear.unionByName(held.select(*[new if name == text_col else c for name, c in zip(df.columns, columns(df), strict=True)]))
