"""License scan over a positional rare-token index, native expressions only.

The templates are the notices by which licences are named, and the whole texts of short licences. Each is looked up by a word of its own: of the words of its first key
phrase the rarest one (highest IDF over the corpus). A place of that word in the file less its place in the
template is a relative position. There all words of the template vote, and a template of which two words and a share of LEAST_SHARE or
more agree is a candidate. A candidate counts only if its mandatory key phrases stand where that position puts them: the
first one exactly, any further one at most INSERTED words before or after its place. Whatever else the file holds,
no template is left out: the phrase that a template must have holds the word it is looked up by.

The whole scan is one projection: nothing is shuffled, grouped or joined by document. The only
aggregation is the document frequency of the template words, a table as long as the templates' vocabulary.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .quality import let

#: The base phrases and labels of the contract.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Labels, and the names of licences on a line that says SPDX-License-Identifier, as words.
SPDX = (
    ("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"), ("agpl-3.0", "agpl 3 0"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("isc", "isc"), ("mpl-2.0", "mpl 2 0"), ("epl-2.0", "epl 2 0"), ("cc0-1.0", "cc0 1 0"), ("bsl-1.0", "bsl 1 0"), ("unlicense", "unlicense"),
)
#: Label, notice, mandatory key phrases. The wording is the usual notice of each licence.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl", "licensed under the gnu general public license", ("general public license",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "released under the cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3", ("gnu general public license as published by the free software foundation", "version 3")),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2", ("gnu general public license as published by the free software foundation", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 2 or version 3", ("gnu general public license", "version 2 or version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 3 or version 2", ("gnu general public license", "version 3 or version 2")),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3", ("gnu affero general public license as published by the free software foundation", "version 3")),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", ("gnu lesser general public license as published by the free software foundation", "version 2 1")),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3", ("gnu lesser general public license as published by the free software foundation", "version 3")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages arising from the use of this software",)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted free of charge", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is",
        ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "materials provided with the distribution this software is provided"),
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "may be used to endorse or promote products derived from this software"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("for any purpose with or without fee is hereby granted", "the author disclaims all warranties with regard to this software"),
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
        ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license", "if a copy of the mpl was not distributed with this file"),
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("neither the name of", "may be used to endorse or promote products derived from this software"),
    ),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license 2 0",)),
    ("epl-2.0", "eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("epl-1.0", "eclipse public license v 1 0", ("eclipse public license v 1 0",)),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ("common development and distribution license",)),
    ("artistic-2.0", "licensed under the artistic license 2 0", ("artistic license 2 0",)),
    ("artistic-2.0", "the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("artistic license 2 0",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license", "version 1 0")),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license", "version 1 1")),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    ("psf-2.0", "python software foundation license version 2", ("python software foundation license", "version 2")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", ("gnu general public license version 3 29 june 2007",)),
    ("gpl-2.0", "gnu general public license version 2 june 1991", ("gnu general public license version 2 june 1991",)),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", ("gnu lesser general public license version 3 29 june 2007",)),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", ("gnu lesser general public license version 2 1 february 1999",)),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", ("gnu affero general public license version 3 19 november 2007",)),
) + tuple((label, f"spdx license identifier {name}", (f"license identifier {name}",)) for label, name in SPDX)

#: Part of a template's words that has to agree; the shortest way in which a notice names its licence has a quarter.
LEAST_SHARE = 0.25
#: Words by which a further key phrase may be off its place: "License (GPL), version 3", "License, either version 3".
INSERTED = 2

_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
#: Letters of a word that texts are told apart by, if a phrase has one.
LEAST_SIGN = 5
_INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


_TABLE = "array<struct<t int, notice array<string>, word string, k int, keys array<struct<padded string, words array<string>, at int, off int>>>>"


def spaced(text: Column) -> Column:
    """The words in small letters, each with a blank of its own on either side, so that phrases are plain substrings."""
    low = F.translate(text, _A_Z, _A_Z.lower())
    return F.concat(F.lit(" "), F.regexp_replace(low, _BETWEEN, "  "), F.lit(" "))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _A_Z, _A_Z.lower()), F.lit(_INSIDE), F.lit(0))


def _padded(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def starts_of(words: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase's words stand one after the other. ``words``: a bound column."""
    parts = phrase.split()

    def here(w: Column, i: Column) -> Column:
        ok = w == F.lit(parts[0])
        for k, p in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + F.lit(k)) == F.lit(p), F.lit(False))
        return F.when(ok, i.cast("long"))

    return F.array_compact(F.transform(words, here))


def vocabulary() -> list[str]:
    """The words by which templates may be looked up: those of their first key phrases."""
    return sorted({w for _, _, keys in TEMPLATES for w in keys[0].split()})


def signs() -> list[str]:
    """A few words of which every text that a template or a base phrase fits holds one, picked from the key phrases.

    Again and again the word that the most phrases still without one have; of equal ones the longest. A template needs all its
    key phrases, so any of their words will do.
    """
    open_ = [{w for k in keys for w in k.split()} for keys in [[p] for p, _ in BASE] + [keys for _, _, keys in TEMPLATES]]
    out = []
    while open_:
        count = Counter(w for ws in open_ for w in ws)
        best = max(count, key=lambda w: (count[w] if len(w) >= LEAST_SIGN else 0, len(w), w))
        out.append(best)
        open_ = [ws for ws in open_ if best not in ws]
    return out


def may_hold(text: Column) -> Column:
    """A cheap test that is true for every text in which a phrase can stand, however its words are parted: most texts go no further."""
    return text.rlike(f"(?i)(?<![{_LETTERS}])(?:{'|'.join(signs())})(?![{_LETTERS}])")


def frequencies(df: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the vocabulary, over all documents.

    Other words aren't counted, so the table has one row per word of the vocabulary at most. The counts only say which
    word of a phrase is the rarest; any of them finds every place of the phrase.
    """
    words = F.split(F.lower(text_of(text_col)), _BETWEEN)
    rows = df.select(F.array_intersect(words, F.array(*map(F.lit, vocabulary()))).alias("w"))
    total = df.count()
    return total, {r["w"]: r["n"] for r in rows.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def anchor(notice: str, key: str, idf: dict[str, float]) -> tuple[str, int]:
    """The word that a template is looked up by, the rarest of its key phrase, and its place in the notice."""
    first, parts = place_of(notice, key), key.split()
    k = max(range(len(parts)), key=lambda i: (idf.get(parts[i], 0.0), -i))
    return parts[k], first + k


def place_of(notice: str, key: str) -> int:
    """Word number, from 0, at which a key phrase stands in its notice."""
    words, parts = notice.split(), key.split()
    return next(i for i in range(len(words)) if words[i:i + len(parts)] == parts)


def matches(words: Column, wide: Column, idf: dict[str, float]) -> Column:
    """array<struct<template int, share double>>: templates that are candidates at some relative position and pass their key phrases.

    ``words``, ``wide``: bound columns, the words and the same text with blanks. Share: of the template's
    words, the part that agrees on its best relative position.
    """
    made = []
    for t, (_, notice, keys) in enumerate(TEMPLATES):
        word, k = anchor(notice, keys[0], idf)
        phrases = [{"padded": _padded(x), "words": x.split(), "at": place_of(notice, x), "off": INSERTED if n else 0} for n, x in enumerate(keys)]
        made.append({"t": t, "notice": notice.split(), "word": word, "k": k, "keys": phrases})
    table = F.from_json(F.lit(json.dumps(made)), _TABLE)
    wanted = sorted({x["word"] for x in made})
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*wanted), F.struct(w.alias("w"), i.alias("i")))))

    def stands(at: Column, key: Column) -> Column:
        def here(d: Column) -> Column:
            i = at + key["at"] + d
            return (i >= 0) & (F.slice(words, F.greatest(i, F.lit(0)) + 1, F.size(key["words"])) == key["words"])

        return F.exists(F.sequence(-key["off"], key["off"]), here)

    def votes(at: Column, notice: Column) -> Column:
        return F.size(F.filter(F.transform(notice, lambda w, k: (at + k >= 0) & (F.get(words, at + k) == w)), lambda x: x))

    def one(hs: Column, t: Column) -> Column:
        ats = F.transform(F.filter(hs, lambda h: h["w"] == t["word"]), lambda h: h["i"] - t["k"])
        ats = F.filter(ats, lambda at: F.forall(t["keys"], lambda key: stands(at, key)))
        agree = F.array_max(F.transform(ats, lambda at: votes(at, t["notice"])))
        return let(agree, lambda n: F.when((n >= 2) & (n >= F.lit(LEAST_SHARE) * F.size(t["notice"])), F.struct(t["t"].alias("template"), (n / F.size(t["notice"])).alias("share"))))

    held = F.filter(table, lambda t: F.forall(t["keys"], lambda key: F.contains(wide, key["padded"])))
    return let(hits, lambda hs: F.array_compact(F.transform(held, lambda t: one(hs, t))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Null and empty texts have no words, no labels and a score of 0. Each row is judged by itself:
    repeated rows give repeated results, ids (null ones too) only name rows. Very long texts are scanned whole. Extra
    columns are ignored. An empty table gives no rows. A word is a run of ASCII letters, digits and anything beyond ASCII.
    Score: 1 where a base phrase stands, else the best share of agreeing template words, else 0.
    """
    n, df_of = frequencies(df, text_col)
    idf = {w: math.log((1 + n) / (1 + df_of.get(w, 0))) for w in vocabulary()}
    text = F.col("_text")
    none = F.array().cast("array<bigint>")
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_may", may_hold(text)).withColumn(
        "n_words", F.size(F.regexp_extract_all(text, F.lit(_INSIDE), F.lit(0))).cast("long")
    )
    rows = rows.withColumn("_words", F.when(F.col("_may"), words_of(text))).withColumn("_wide", F.when(F.col("_may"), spaced(text)))
    w = F.col("_words")
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"_at{k}", F.when(F.col("_may") & F.col("_wide").contains(_padded(phrase)), starts_of(w, phrase)).otherwise(none))
    at = F.concat(*[F.col(f"_at{k}") for k in range(len(BASE))])
    empty = F.array().cast("array<struct<template:int,share:double>>")
    rows = rows.withColumn("_at", at).withColumn("_found", F.when(F.col("_may"), matches(w, F.col("_wide"), idf)).otherwise(empty))
    base = F.array_compact(F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    label_of = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    more = F.transform("_found", lambda x: F.get(label_of, x["template"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").alias("first_word"), F.array_max("_at").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), score.alias("score"),
    )


def brute_force(text: str | None) -> tuple:
    """The base part of a row, by plain loops; for tests."""
    words = re.findall(_INSIDE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
