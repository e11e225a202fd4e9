"""Plain versions of what the operators promise."""

import base64
import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(rows, n, num, den):
    """(id, set size, component) of rows of distinct ids."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root, holders = {i: i for i in sets}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    for i in sets:
        for j, both in Counter(j for g in sets[i] for j in holders[g] if j < i).items():
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in sets}


def without_repeats(rows, window=35):
    """(id, words, removed, kept words) of each row, in order."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def sequences(ids, end, length=128):
    """A text's ids and an end mark in rows, the last filled up with end marks."""
    own = [*ids, end]
    own += [end] * (-len(own) % length)
    return [np.array(own[i:i + length], "<u2") for i in range(0, len(own), length)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    count, covered = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if count[tuple(w[i:i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def kept(text):
    """Whether a text passes the base and every rule, by plain counting."""
    words, chars, symbols, dup, repeated = quality(text)
    if words < 10 or 100 * repeated > 20 * words:
        return False
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += len(WORD.findall(line)) if line in seen else 0
            seen.add(line)
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    capitals = sum(unicodedata.category(c) == "Lu" for c in text)
    return not (10 * symbols > 3 * words or (dup and 10 * again > 3 * words) or not 2 * words <= chars <= 25 * words or 2 * capitals > letters)


def licenses(text, templates, off=2, share=0.25):
    """Labels of the templates a share of whose words agree on a relative position, and whose key phrases stand there, further ones within ``off`` words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))
    found = set()
    for label, notice, keys in templates:
        n = notice.split()
        if not all(f" {k} " in f" {' '.join(w)} " for k in keys):
            continue
        place = [next(i for i in range(len(n)) if n[i:i + len(k.split())] == k.split()) for k in keys]
        votes = Counter(i - k for i, x in enumerate(w) for k, y in enumerate(n) if x == y)
        for at in (x for x, v in votes.items() if v >= max(2, share * len(n))):
            if all(any(at + p + d >= 0 and w[at + p + d:at + p + d + len(k.split())] == k.split() for d in (range(-off, off + 1) if m else (0,))) for m, (k, p) in enumerate(zip(keys, place, strict=True))):
                found.add(label)
    return ",".join(sorted(found))


def archive(rows):
    by = {}
    for p, h in rows:
        by.setdefault((h or "").encode(), []).append(p)
    out = set()
    for p, h in rows:
        data = (h or "").encode()
        first = min(by[data])
        out.add((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if p == first else ("revisit", first))))
    return out


def mix(sizes, sources, weights=(1, 2, 3), most=3):
    """Targets by source: clamp what is above, reshare, again."""
    total = {}
    for s, n in zip(sources, sizes, strict=True):
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(total.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w >= most * total[s]}
        if not over:
            return target | {s: rest * weight[s] / w for s in open_}
        for s in over:
            target[s] = most * total[s]
            rest -= target[s]
        open_ -= over
    return target
