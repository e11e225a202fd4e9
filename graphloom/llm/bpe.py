"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its encoding. The tokens that end at
a position, that is, the suffixes of the prefix that are in the vocabulary, come from an Aho-Corasick automaton: its
state is the longest such suffix that begins a token, and its failure links lead through all shorter ones. The one that counts is compatible with the
last token of the prefix before it, that is, encoding the two together gives just these two. The last
tokens are stored with each prefix, and back-pointers from the end of the word give its ids. No merge
loop is run.

The vocabulary is read from a file of the ``tokenizers`` library (``model`` with ``vocab``, ``merges`` and an
``end_of_word_suffix``); its path is a parameter. Executors read the same path, where the library's files
are installed.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 60
#: A word's last symbol is another symbol than the same byte inside a word.
_END = 0x10000
#: Distinct words whose encodings one Python worker keeps, and the longest of them; beyond it the oldest quarter goes.
CACHE_WORDS, CACHE_LENGTH = 600_000, 64
#: Pairs of tokens whose compatibility one Python worker keeps.
CACHE_PAIRS = 600_000
#: Every character below this has the same Unicode properties in all versions, and is its own NFC form.
_PLAIN_END = "ɏ"


class Bpe:
    """Tables made from a vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.names = {i: s for s, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(f"({regex.escape(x)})" for x in self.added)) if self.added else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = re.compile(f"[\\x00-{_PLAIN_END}]*")
        self.ascii_split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_char = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else "" for b in range(256)]
        spare = iter(range(256, 512))
        self.byte_char = [c or chr(next(spare)) for c in self.byte_char]
        self.pair, made = {}, {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            ids = (vocab[a], vocab[b])
            self.pair[ids] = rank
            made[vocab[a + b]] = (rank, *ids)
        self.made = made
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._fits: dict[int, bool] = {}
        self.length = [0] * (max(vocab.values()) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in vocab.items():
            if i in made and self.crossing(*made[i][1:], before=made[i][0] + 1) != made[i][0]:
                continue  # no text is ever encoded with it
            body = s.removesuffix(self.suffix)
            key = body[:-1] + chr(ord(body[-1]) + _END) if body != s and body else s
            self.length[i] = len(key)
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The symbols that stand at one edge of the token while it is put together: (symbol, made at, merged away at)."""
        held = self._left if side == 1 else self._right
        if token not in held:
            out, until, at = [], NEVER, token
            while True:
                born = self.made[at][0] if at in self.made else -1
                out.append((at, born, until))
                if at not in self.made:
                    break
                until, at = born, self.made[at][side]
            held[token] = out
        return held[token]

    def crossing(self, first: int, second: int, before: int = NEVER) -> int | None:
        """Rank of the earliest merge over the boundary of two tokens that happens, if any does below ``before``.

        It happens if its two symbols stand at the boundary at its turn: made earlier and not yet merged
        away. Equal turns go from left to right, so a merge inside the first token comes before it and one
        inside the second after it.
        """
        found = None
        for a, a_from, a_to in self.spine(first, 2):
            for b, b_from, b_to in self.spine(second, 1):
                m = self.pair.get((a, b))
                if m is not None and a_from < m < a_to and b_from < m <= b_to and m < before and (found is None or m < found):
                    found = m
        return found

    def fits(self, first: int, second: int) -> bool:
        """Whether encoding the two tokens' text together gives just these two."""
        if len(self._fits) > CACHE_PAIRS:
            self._fits.clear()
        got = self._fits[first << 20 | second] = self.crossing(first, second) is None
        return got

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as byte characters."""
        s = symbols[:-1] + chr(ord(symbols[-1]) + _END)
        last = [-1] * len(s)
        length, known = self.length, self._fits.get
        for end, t in self.automaton.iter(s):
            if last[end] < 0:
                at = end - length[t]
                if at < 0:
                    last[end] = t
                elif (before := last[at]) >= 0:
                    ok = known(before << 20 | t)
                    if ok or (ok is None and self.fits(before, t)):
                        last[end] = t
        out, at = [], len(s) - 1
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """The words of a text without special tokens; and whether they are text yet, or bytes written as characters.

        White space only parts words, so it needs no normalising. In small letters a plain text has the words
        that the library finds; for any other text the library's own normaliser and splitter are asked.
        """
        if text.isascii():
            return self.ascii_split.findall(text.lower()), True
        if self.plain.fullmatch(text):
            return self.split.findall(text.lower()), True
        return [x for x, _ in self.pre_tokenize(self.normalize(text))], False

    def encode(self, text: str, cache: dict[str, bytes]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.added_pattern is not None and any(x in text for x in self.added):
            out = []
            for x in self.added_pattern.split(text):
                if x:
                    out.append(np.array([self.added[x]], dtype="<u4").tobytes() if x in self.added else self._encode(x, cache))
            return b"".join(out)
        return self._encode(text, cache)

    def _encode(self, text: str, cache: dict[str, bytes]) -> bytes:
        words, plain = self.pieces(text)
        if not plain:
            return b"".join([struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.word, words)])
        out = list(map(cache.get, words))
        if None in out:
            byte_char = self.byte_char.__getitem__
            for i, got in enumerate(out):
                if got is None:
                    w = words[i]
                    got = cache.get(w)
                    if got is None:
                        ids = self.word(w if w.isascii() and w.isprintable() else "".join(map(byte_char, w.encode())))
                        got = struct.pack(f"<{len(ids)}I", *ids)
                        if len(w) <= CACHE_LENGTH:
                            if len(cache) >= CACHE_WORDS:
                                for k in list(islice(cache, CACHE_WORDS // 4)):
                                    del cache[k]
                            cache[w] = got
                    out[i] = got
        return b"".join(out)

    @property
    def token_table(self) -> np.ndarray:
        table = np.empty(max(self.names) + 1, dtype=object)
        for i, s in self.names.items():
            table[i] = s
        return table


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Bpe, dict, np.ndarray]:
    """Once for a Python worker: tables, word cache and token strings."""
    bpe = Bpe(path)
    return bpe, {}, bpe.token_table


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of its whole texts: binary, little-endian unsigned 32-bit. Null texts count as empty: no ids.

    No shuffle; each row by itself, so repeated rows give repeated results. A column ``ids_col`` is replaced.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def ids(texts):
        import pyarrow as pa

        bpe, cache, _ = load(path)
        return pa.array([bpe.encode(x, cache) if x else b"" for x in texts.to_pylist()], type=pa.binary())

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids. The vocabulary names no decoder: tokens are joined by one blank."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def text(ids):
        import pyarrow as pa

        table = load(path)[2]
        return pa.array([" ".join(table[np.frombuffer(x, dtype="<u4")].tolist()) if x else "" for x in ids.to_pylist()], type=pa.string())

    return df.withColumn(text_col, text(F.col(ids_col)))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256, from the ids and the decoded texts.

    Null and empty texts have no ids and decode to the empty text; very long texts and words are encoded whole. Null and
    repeated ids and repeated rows each give their row. Extra columns are ignored. An empty table gives no rows.
    """
    both = decode(encode(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path), path)
    return both.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
