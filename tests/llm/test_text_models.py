"""Resampling, alignment and pieces against plain versions and the libraries."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import alignment, pieces, queries, resampling

from . import brute
from .test_operators import ODD, SCHEMA, frame

ALPHABET = "   ▁\n\n\t\r\x85\x1c　\xa0abcehistoruABC.,;:'!0123éßñ日本語한😀\0──"


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd():
    """Texts of characters that either tokenizer treats by a rule of its own."""
    rng = random.Random(2)
    own = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(1_500)]
    return [*own, "it's <|endoftext|> don't", "<s> x </s>", " ", "\n", " " * 300 + "x", "ab" * 3_000, None, ""]


# ---- resampling --------------------------------------------------------------------------------


def plain_draw(rows, target, buckets, seed, least, percent):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(text))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    each = [(i, *found(t)) for i, t in rows]
    s, t = Counter(k for _, _, f in each for k in f), Counter(k for x in target for k in found(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (n_s + buckets) / ((s[k] + 1) * (n_t + buckets)))) for k in range(buckets)]
    out = []
    for i, n, f in each:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    ranked = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    ranked, rest = ranked[:len(ranked) * percent // 100], ranked[len(ranked) * percent // 100:]
    return [(*x[:4], k) for k, x in enumerate(ranked, 1)] + [(*x[:4], None) for x in [*rest, *(x for x in out if x[4] < least)]]


def same(df, expected):
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(expected, key=str)


def test_resampling(spark, rows):
    target = [t for _, t in rows[::7]]
    own = rows + [(10_000 + i, t) for i, t in ODD]
    wanted = spark.createDataFrame([(t, 1) for t in [*target, None, ""]], "text string, score int")
    same(resampling.resampled(frame(spark, own), wanted), plain_draw(own, target, 10_000, 7, 20, 25))


def test_resampling_of_ties(spark):
    """Null and repeated ids, repeated rows, few buckets; all rows drawn, some, none; empty tables on either side."""
    texts = ["a b c d", "b c d e f", "x y", "", None, "A  B-c d", "é b", "word " * 40]
    rng = random.Random(5)
    own = [(rng.choice([None, 1, 2, 3]), rng.choice(texts)) for _ in range(300)] + [(9, "a b c d")] * 50
    df = frame(spark, own)
    wanted = spark.createDataFrame([("b c",), ("x",)], "text string")
    for percent in (100, 37, 1, 0):
        same(resampling.resampled(df, wanted, buckets=5, seed=3, least_words=2, percent=percent), plain_draw(own, ["b c", "x"], 5, 3, 2, percent))
    same(resampling.resampled(df, wanted.limit(0), buckets=5, least_words=0), plain_draw(own, [], 5, 7, 0, 25))
    assert resampling.resampled(df.limit(0), wanted).count() == 0
    assert resampling.resampled(spark.createDataFrame([(1, "too short")], SCHEMA), wanted).first()["rank"] is None


# ---- alignment ---------------------------------------------------------------------------------


class Plain:
    """Both libraries, and what the alignment of their tokens should be."""

    def __init__(self):
        self.a = Tokenizer.from_file(queries.byte_bpe_path())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.piece_bpe_path())
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in kept)}

    def spans(self, names):
        ends = np.cumsum(list(map(len, names))).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def aligned(self, text, links):
        """(A ids, B ids, groups as text, linked id pairs) or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        names_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        names_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if {b"".join(names_a), b"".join(names_b)} != {(" " + text).encode()}:
            return None
        of_a, of_b = self.spans(names_a), self.spans(names_b)
        shared = sorted({y for _, y in of_a} & {y for _, y in of_b})
        group = lambda span: bisect.bisect_left(shared, span[1])
        side = lambda ids, spans, g: ",".join(str(i) for i, s in zip(ids, spans, strict=True) if group(s) == g)
        text = ";".join(f"{side(a, of_a, g)}|{side(b, of_b, g)}" for g in range(len(shared)))
        linked = {"ends": lambda x, y: x[1] == y[1], "overlaps": lambda x, y: x[0] < y[1] and y[0] < x[1], "groups": lambda x, y: group(x) == group(y)}[links]
        return a, b, text, [(i, j) for i, x in zip(a, of_a, strict=True) for j, y in zip(b, of_b, strict=True) if linked(x, y)], len(shared)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected_alignment(plain, own, links):
    found = [(i, plain.aligned(t, links)) for i, t in own]
    count = Counter(p for _, x in found if x for p in x[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, len(x[0]), len(x[1]), x[4], len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(x[2].encode()).hexdigest()))
    return out


@pytest.mark.parametrize("links", alignment.LINKS)
def test_alignment(spark, rows, odd, plain, links, monkeypatch):
    """Every kind of link, blocks of few texts, repeated and null ids, further columns."""
    own = [(i, (t or "")[:500]) for i, t in rows[:60]] + [(10_000 + i, t[:90] if t else t) for i, t in ODD] + [(None, "one"), (None, "one"), (4, "the mit license")]
    own += [(20_000 + k, t) for k, t in enumerate(odd[:400])] + [(30_000, "x" * 300), (30_001, None)]
    df = frame(spark, own).repartition(3)
    found = alignment.scored(df, queries.byte_bpe_path(), queries.piece_bpe_path(), links).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected_alignment(plain, own, links), key=str)


def test_alignment_counts(spark, rows, plain, monkeypatch):
    """The corpus-wide counts of id pairs, and the groups as text; an empty table."""
    own = [(i, (t or "")[:300]) for i, t in rows[:40]]
    df = frame(spark, own).repartition(4)
    held = alignment.alignments(df, queries.byte_bpe_path(), queries.piece_bpe_path())
    want = {i: plain.aligned(t, "ends") for i, t in own}
    assert {(r.a, r.b): r.n for r in alignment.correspondences(held, 32_000).collect()} == Counter(p for x in want.values() if x for p in x[3])
    assert {r.doc_id: r.groups for r in held.collect()} == {i: x[2] if x else "" for i, x in want.items()}
    assert alignment.scored(df.limit(0), queries.byte_bpe_path(), queries.piece_bpe_path()).count() == 0
    with pytest.raises(ValueError):
        alignment.Aligner(queries.byte_bpe_path(), queries.piece_bpe_path(), "near")


def test_blocks_are_joined_and_parted(monkeypatch):
    """Segments that each worker aligns in pieces give what they give at once, with caches that hold nearly nothing too."""
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 3)
    monkeypatch.setattr(alignment, "PRODUCT", 7)
    texts = ["it was the best of times, it was the worst of times", "ababab" * 30, "no ▁ here", "tail  \t ", None]
    for links in alignment.LINKS:
        one = alignment.Aligner(queries.byte_bpe_path(), queries.piece_bpe_path(), links)
        assert [one.texts([t])[0] for t in texts] == one.texts(texts) == one.texts(texts)


# ---- pieces ------------------------------------------------------------------------------------


def expected_digests(library, own):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(i, library.encode(t or "")) for i, t in own]
    return sorted([(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids], key=str)


def test_pieces(spark, rows, odd, plain):
    own = rows + [(10_000 + i, t) for i, t in ODD] + [(None, "one"), (None, "one")] + [(20_000 + k, t) for k, t in enumerate(odd)]
    df = frame(spark, own).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    found = sorted((tuple(r) for r in pieces.digests(df, queries.piece_bpe_path()).collect()), key=str)
    assert found == expected_digests(plain.b, own)
    assert pieces.digests(df.limit(0), queries.piece_bpe_path()).count() == 0
    back = pieces.decode(pieces.encode(df.select("doc_id", "text"), queries.piece_bpe_path()), queries.piece_bpe_path()).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)


def test_pieces_of_any_text(plain, monkeypatch):
    """Texts put together from pieces, so that merges compete; any ids decoded; caches that hold nearly nothing."""
    monkeypatch.setattr(pieces, "CACHE_STRETCHES", 50)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 1_000)
    own, library, rng, cache = pieces.Pieces(queries.piece_bpe_path()), plain.b, random.Random(4), {}
    texts = ["".join(rng.choice(own.names[259:]) for _ in range(rng.randint(1, 6))) for _ in range(6_000)]
    got = own.encode(texts, cache)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == library.encode(texts)
    for _ in range(2_000):
        ids = [rng.randrange(300) if rng.random() < 0.5 else rng.randrange(32_000) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, dtype=int)) == library.decode(ids)


def test_very_long_texts(spark, plain):
    """Texts of millions of characters, one of a single huge word, through all three; each whole."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(5_000)]
    own = [(1, " ".join(rng.choice(words) for _ in range(400_000))), (2, "ab" * 300_000), (3, " " * 50_000)]
    df = spark.createDataFrame(own, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in pieces.digests(df, queries.piece_bpe_path()).collect()), key=str) == expected_digests(plain.b, own)
    found = {r.doc_id: (r.n_a, r.n_b) for r in alignment.scored(df, queries.byte_bpe_path(), queries.piece_bpe_path()).collect()}
    assert found == {i: (len(plain.a.encode(" " + t, add_special_tokens=False).ids), len(plain.b.encode(t))) for i, t in own}
    same(resampling.resampled(df, spark.createDataFrame([("abc",)], "text string")), plain_draw(own, ["abc"], 10_000, 7, 20, 25))


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, df = con.execute(queries.ORACLE["op11_resampling"]), queries.op11_resampling(spark, sf_dir)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    same(df.select(*names), found.fetchall())
