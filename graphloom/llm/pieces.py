"""SentencePiece encoding of merge type by a table over prefixes, and decoding.

For every prefix of a text there is exactly one piece that can end its encoding. The pieces that end at a position come
from an Aho-Corasick automaton; the one that counts is compatible with the last piece of the prefix before it, that is,
merging the two pieces' text by itself gives just these two. The last pieces are stored with each prefix, and
back-pointers from the end give the ids. No merge loop is run over a text.

Why this is exact: merges happen in order of score, from left to right among equal ones, and two symbols merge whenever
their joined text is a piece. As long as no merge crosses a boundary, either side goes on as it would alone; so a run of
pieces is the encoding if and only if no two neighbours would merge across their boundary, which their two histories
tell, played against each other.

Texts are made of many rare words, so the table is filled for many stretches at once: one numpy step a position moves all
their automaton states on, and walks the pieces that end there from the longest on.

A text is cut where no piece can reach across: before a run of the space mark, if the vocabulary has none inside a
piece, and between characters that no chain of neighbours inside pieces connects, such as letters and stops. Encodings of such
stretches are kept by each Python worker.

The model is a file of the ``sentencepiece`` library; its path is a parameter. Executors read the same path, where the
library's files are installed.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a blank inside pieces; a text may hold either, they count as equal. Here it's the blank that is worked with.
MARK = "▁"
#: Stretches whose encodings one Python worker keeps, and the longest of them; beyond it the oldest go.
CACHE_STRETCHES, CACHE_LENGTH = 700_000, 48
#: Pairs of pieces whose compatibility one Python worker keeps.
CACHE_PAIRS = 600_000
#: Characters that the automaton's table has moves for, and characters of text whose new stretches are encoded at once.
COMMON, SLICE = 200, 2_000_000
#: Stretches in one table, which are of like length.
TOGETHER = 8_192
#: A pair of pieces is a number: the first one's id above so many bits.
_BITS, _SPREAD = 20, np.uint64(0x9E3779B97F4A7C15)
#: Marks a character that is part of no piece: nothing merges with it.
ALONE = -2
#: What the library writes for the unknown piece.
UNKNOWN = " ⁇ "


class Pieces:
    """Tables made from a model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        every = range(self.size)
        self.names = [model.id_to_piece(i) for i in every]
        self.control = {i for i in every if model.is_control(i)}
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        special = self.control | set(self.byte_of) | {self.unknown}
        self.score = {self.names[i].replace(MARK, " "): model.get_score(i) for i in every if i not in special}
        self._check(model)
        byte_ids = {b: i for i, b in self.byte_of.items()}
        if len(byte_ids) != 256:
            raise ValueError("a model without a piece for each byte isn't supported")
        self.ids_of_byte = [byte_ids[b] for b in range(256)]
        self.pieces = [x.replace(MARK, " ") for x in self.names]
        self.inside = inside = {c for s in self.score for c in s}
        # characters of pieces that are no piece by themselves still stand in texts: they get numbers beyond the ids
        self.pieces += sorted(inside - set(self.score))
        self.length = [len(s) for s in self.pieces]
        self.marks_first = not any(" " in s.lstrip(" ") for s in self.score)
        self.stretches = self._cuts() if self.marks_first else re.compile(r".+", re.S)
        # for decoding: characters of one byte are text by themselves
        self.shown = np.array([chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else x for i, x in enumerate(self.pieces)], dtype=object)
        self.special = np.array([i in special and self.byte_of.get(i, 128) >= 128 for i in range(len(self.pieces))])
        self.histories: dict[int, tuple] = {}
        for i, s in enumerate(self.pieces):
            if i in special:
                continue
            history = self._history(s)
            if history is not None:  # else no text is ever encoded with it
                self.histories[i] = history
        self._tables()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in self.histories:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._known, self._fits = np.full(CACHE_PAIRS, -1, dtype=np.int64), np.zeros(CACHE_PAIRS, dtype=bool)

    def _check(self, model) -> None:
        """The model has to be of merge type, its texts unchanged but for blanks: anything else isn't what this module encodes."""
        for text, want in (("a  b ", MARK + "a" + 2 * MARK + "b" + MARK), (" ﬁÁ", 2 * MARK + "ﬁÁ")):
            shown = "".join(model.encode(text, out_type=str))
            if shown != want and model.unk_id() not in model.encode(text):
                raise ValueError("a model that changes its texts, or that adds no blank before them, isn't supported")
        if any(model.is_unused(i) for i in range(self.size)):
            raise ValueError("a model with unused pieces isn't supported")

    def _cuts(self) -> re.Pattern:
        """Stretches: blanks and what follows them of one group of characters that stand next to each other in pieces; other characters one by one."""
        root, doubled = {c: c for c in self.inside if c != " "}, set()

        def find(c: str) -> str:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for s in self.score:
            own = s.lstrip(" ")
            for a, b in zip(own, own[1:]):  # noqa: B905
                root[find(a)] = find(b)
                doubled |= {a} if a == b else set()
        groups: dict[str, list[str]] = {}
        for c in root:
            groups.setdefault(find(c), []).append(c)
        sets = ["".join(map(re.escape, sorted(g))) for g in sorted(groups.values(), key=len, reverse=True) if len(g) > 1 or g[0] in doubled]
        return re.compile(f" *(?:{'|'.join([f'[{x}]+' for x in sets])}|[^ {''.join(sets)}])| +" if sets else " *[^ ]| +", re.S)

    def _history(self, piece: str):
        """The merges that put a piece together when it stands alone, or None if they don't end in the piece itself.

        A list of (score of the next merge, last symbol, first symbol), one for each state from single characters on; the last has no merge.
        """
        symbols, states = list(piece), []
        while True:
            best = None
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, k)
            states.append((None if best is None else best[0], symbols[-1], symbols[0]))
            if best is None:
                return tuple(states) if len(symbols) == 1 else None
            k = best[1]
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]

    def apart(self, first: int, second: int) -> bool:
        """Whether the two pieces stay apart: no merge over their boundary has its turn while both are put together.

        The two histories are played against each other: the higher score comes first; of equal ones the left piece's,
        then the one over the boundary, then the right piece's.
        """
        left, right, score = self.histories[first], self.histories[second], self.score.get
        i = j = 0
        while True:
            a, b = left[i][0], right[j][0]
            over = score(left[i][1] + right[j][2])
            if over is not None and (a is None or over > a) and (b is None or over >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def _tables(self) -> None:
        """Aho and Corasick's automaton of all pieces that texts are encoded with.

        Where characters are common (``code``) its moves are a table, failures worked in; ``head`` is the longest piece that ends
        in a state, ``link`` the next shorter one that ends where a piece does.
        """
        count = Counter(c for i in self.histories for c in self.pieces[i])
        self.code = {c: k for k, (c, _) in enumerate(count.most_common(COMMON))}
        self.common = re.compile(f"[{''.join(map(re.escape, self.code))}]{{1,{CACHE_LENGTH}}}")
        own = [i for i in self.histories if all(c in self.code for c in self.pieces[i])]
        ahead: list[dict[int, int]] = [{}]
        piece_at = {}
        for i in own:
            at = 0
            for c in self.pieces[i]:
                k = self.code[c]
                if k not in ahead[at]:
                    ahead[at][k] = len(ahead)
                    ahead.append({})
                at = ahead[at][k]
            piece_at[at] = i
        move = np.zeros((len(ahead), len(self.code)), dtype=np.int32)
        self.head, self.link = np.full(len(ahead), -1, dtype=np.int32), np.full(len(self.pieces), -1, dtype=np.int32)
        queue = deque([(0, 0)])
        while queue:
            at, back = queue.popleft()  # a state and the one of its longest proper suffix
            after = move[back].copy() if at else move[0].copy()
            if at:
                i = piece_at.get(at)
                if i is not None:
                    self.link[i] = self.head[back]
                self.head[at] = self.head[back] if i is None else i
            for k, to in ahead[at].items():
                queue.append((to, int(after[k]) if at else 0))
                after[k] = to
            move[at] = after
        self.move = move
        self.lengths = np.array(self.length, dtype=np.int32)

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each second piece may follow the first; pairs are worked out when they are first met and kept in a table of fixed size."""
        pair = first.astype(np.int64) << _BITS | second
        at = ((pair.view(np.uint64) * _SPREAD) >> np.uint64(32)).astype(np.int64) % CACHE_PAIRS
        ok = self._fits[at]
        new = np.flatnonzero(self._known[at] != pair)
        if len(new):
            fresh, which = np.unique(pair[new], return_inverse=True)
            found = np.array([self.apart(x >> _BITS, x & (1 << _BITS) - 1) for x in fresh.tolist()])
            ok[new] = found[which]
            self._known[at[new]], self._fits[at[new]] = pair[new], ok[new]
        return ok

    def table(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch of common characters, by the table over its prefixes."""
        order = sorted(range(len(stretches)), key=lambda i: -len(stretches[i]))
        size = np.array([len(stretches[i]) for i in order])
        codes = np.zeros((len(order), size[0]), dtype=np.uint8)
        codes[np.arange(size[0]) < size[:, None]] = np.array(list(map(self.code.__getitem__, "".join([stretches[i] for i in order]))), dtype=np.uint8)
        last = np.full((len(order), size[0] + 1), -1, dtype=np.int32)  # column k: the last piece of the prefix of k characters
        state = np.zeros(len(order), dtype=np.int32)
        for p in range(size[0]):
            n = int(np.searchsorted(-size, -p, side="left"))  # stretches longer than p
            state[:n] = self.move[state[:n], codes[:n, p]]
            rows, t = np.arange(n), self.head[state[:n]]
            while len(rows):
                at = p + 1 - self.lengths[t]
                before = last[rows, at]
                ok = at == 0
                ask = np.flatnonzero(before >= 0)
                ok[ask] = self.follows(before[ask], t[ask])
                last[rows[ok], p + 1] = t[ok]
                t = self.link[t[~ok]]
                rows = rows[~ok][t >= 0]
                t = t[t >= 0]
        path, rows, at = np.full_like(last, -1), np.arange(len(order)), size.copy()
        while len(rows):
            t = last[rows, at]
            path[rows, at] = t
            at = at - self.lengths[t]
            rows, at = rows[at > 0], at[at > 0]
        ends = np.cumsum((path >= 0).sum(axis=1)) * 4
        raw = path[path >= 0].tobytes()
        out: list[bytes] = [b""] * len(order)
        for i, a, b in zip(order, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = raw[a:b]
        return out

    def long_stretch(self, text: str) -> bytes:
        """The same table for one stretch of any length and any characters, one position after the other."""
        last = [-1 if c in self.inside else ALONE for c in text]
        length, known, pairs = self.length, self._pairs.get, self._pairs
        for end, t in self.automaton.iter(text):
            if last[end] < 0:
                at = end - length[t]
                before = last[at] if at >= 0 else ALONE
                if before >= 0:
                    ok = known(before << _BITS | t)
                    if ok is None:
                        if len(pairs) > CACHE_PAIRS:
                            pairs.clear()
                        ok = pairs[before << _BITS | t] = self.apart(before, t)
                if before == ALONE or (before >= 0 and ok):
                    last[end] = t
        out, at = [], len(text) - 1
        while at >= 0:
            t = last[at]
            if 0 <= t < self.size:
                out.append(t)
                at -= length[t]
            else:  # no piece: its bytes
                out += [self.ids_of_byte[b] for b in reversed(text[at].encode())]
                at -= 1
        return np.array(out[::-1], dtype=np.int32).tobytes()

    def encode(self, texts: list[str | None], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as native 32-bit integers; ``cache`` keeps the encodings of stretches."""
        out, row = [], 0
        while row < len(texts):
            end, size = row, 0
            while end < len(texts) and (end == row or size < SLICE):
                size += len(texts[end] or "")
                end += 1
            out += self.encode_marked([" " + x if x else "" for x in texts[row:end]], cache)
            row = end
        return out

    def encode_marked(self, texts: list[str], cache: dict[str, bytes], most: int | None = None) -> list[bytes]:
        """The same for texts that already begin with the blank that encoding puts first; the cache holds ``most`` stretches."""
        found = [self.stretches.findall(x.replace(MARK, " ")) for x in texts]
        got = [list(map(cache.get, f)) for f in found]
        missing = [i for i, g in enumerate(got) if None in g]
        fresh = list({s for i in missing for s, ids in zip(found[i], got[i], strict=True) if ids is None})
        common = sorted(filter(self.common.fullmatch, fresh), key=len)
        coded: dict[str, bytes] = {}
        for k in range(0, len(common), TOGETHER):
            coded.update(zip(common[k:k + TOGETHER], self.table(common[k:k + TOGETHER]), strict=True))
        coded |= {s: self.long_stretch(s) for s in fresh if s not in coded}
        for i in missing:
            got[i] = [coded[s] if ids is None else ids for s, ids in zip(found[i], got[i], strict=True)]
        cache.update((s, ids) for s, ids in coded.items() if len(s) <= CACHE_LENGTH)
        for s in list(islice(cache, max(0, len(cache) - (CACHE_STRETCHES if most is None else most)))):
            del cache[s]
        return list(map(b"".join, got))

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids; the blank that encoding puts first is taken away, bytes that are no UTF-8 are replaced one by one."""
        if not len(ids):
            return ""
        if self.special[ids].any() or int(ids[0]) in self.byte_of:
            return self._decode(ids.tolist())
        return "".join(self.shown[ids].tolist()).removeprefix(" ")

    def _decode(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run, first = bytearray(), False
            s = "" if i in self.control else UNKNOWN if i == self.unknown else self.pieces[i]
            if first and s:
                s, first = s if i == self.unknown else s.removeprefix(" "), False
            out.append(s)
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("\ufffd")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Pieces, dict]:
    """Once for a Python worker: tables and the encodings of stretches."""
    return Pieces(path), {}


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of its whole texts as ``array<int>``, without begin or end ids.

    Null and empty texts have no ids; very long texts are encoded whole, stretch by stretch. No shuffle; each row by itself, so
    repeated rows give repeated results and an empty table none. All other columns stay; a column ``ids_col`` is replaced.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<int>")
    def ids(texts):
        import pyarrow as pa

        pieces, cache = load(path)
        coded = pieces.encode(texts.to_pylist(), cache)
        ends = np.cumsum([0, *map(len, coded)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids (``array<int>``); null and no ids give the empty text. A column ``text_col`` is replaced."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def text(ids):
        import pyarrow as pa

        pieces = load(path)[0]
        return pa.array([pieces.decode(x) for x in _rows(ids)], type=pa.string())

    return df.withColumn(text_col, text(F.col(ids_col)))


def _rows(lists):
    """Each list of an Arrow column as numpy, a null one as empty."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    holds = lists.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], holds, strict=True)]


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256, from the ids and the decoded texts.

    Null and empty texts have no ids and decode to the empty text; very long texts are encoded whole. Null and repeated ids and
    repeated rows each give their row. Extra columns are ignored. An empty table gives no rows.
    """
    both = decode(encode(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
