"""Every operator against a plain version, on real rows and on odd ones."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, language, licenses, mixing, neighbours, quality, queries, substrings, tokens, warc

from . import brute

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Mit license mit license MIT-License"), (6, "the cat " * 400), (7, "x" * 5000), (8, "same same"), (9, "same same"),
    (10, "GNU General Public License, version 3. apache license"), (11, "# $ % & | < > * #"), (12, "line a\nline a\n\nline b\nline a"), (13, "Ünïcödé wörds　here ²½ ①"), (14, "<|endoftext|> it's 42!"),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "tid", "n", "size", "id", "slot", "word", "n_words") if clash else ():
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_warc(spark, sf_dir, tmp_path):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    tiny = [(5, "abc"), (3, "abc"), (9, None), (1, ""), (7, "x\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (8, "é\n\n"), (10, "abc"), (11, "z" * 300_000)]
    for own in (pages, tiny):
        df = spark.createDataFrame([(p, "http://a\r\nX: y", h, 1) for p, h in own], "page_id long, url string, html string, digest int")
        found = {tuple(r) for r in warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
        assert found == brute.archive(own)
    path = warc.write(df, str(tmp_path / "w"))
    store = warc.split_store(warc.read(spark, path), str(tmp_path / "s"))
    assert {(int(r.page_id), bytes(r.payload)) for r in warc.restore(spark, store).collect()} == {(p, (h or "").encode()) for p, h in tiny}
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_odd_ids_and_sizes(spark, monkeypatch):
    """Ids of text, one like a missing one; repeated ids; a payload above 10 MB; files of few bytes."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1_000)
    big = "<p>é</p>" * 1_400_000
    df = spark.createDataFrame([("none", "abc"), (None, "abc"), ("", "q"), ("b", big), ("b", big), ("c", big)], "page_id string, html string").withColumn("url", F.lit(None).cast("string"))
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(df).collect()), key=str)
    n = len(big.encode())
    assert found == sorted([("none", 3, "response", None), (None, 3, "revisit", "none"), ("", 1, "response", None), ("b", n, "response", None), ("b", n, "response", None), ("c", n, "revisit", "b")], key=str)


def test_warc_ids_of_any_text(spark, tmp_path):
    """Ids with what ends a record's id or a line come back as they were, also from files."""
    ids = ["a>b", "c\r\nWARC-Type: x", "<%3E>", "\n", "d"]
    df = spark.createDataFrame([(i, "u", "one" if k < 3 else "two") for k, i in enumerate(ids)], "page_id string, url string, html string")
    first = {"one": min(ids[:3]), "two": min(ids[3:])}
    expected = {(i, None if i in first.values() else first["one" if k < 3 else "two"]) for k, i in enumerate(ids)}
    assert {(r.page_id, r.refers_to) for r in warc.archive(df).collect()} == expected
    assert {(r.page_id, r.refers_to) for r in warc.read(spark, warc.write(df, str(tmp_path / "w"))).collect()} == expected


def test_hot_keys_are_split(spark, tmp_path):
    """One payload in four fifths of the pages, one passage in four fifths of the texts: joins on their keys are of plain tables, which adaptive execution splits."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        pages = spark.range(20_000).selectExpr("id AS page_id", "sha2(cast(id AS string), 512) AS url", "CASE WHEN id % 5 < 4 THEN 'one and the same' ELSE cast(id AS string) END AS html").repartition(8)
        sizes = [r.n for r in warc.records(pages).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("url")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 6_000
        for k in list(names)[3:]:
            spark.conf.set(k, "2k")
        passage = " ".join(f"w{i}" for i in range(40))
        docs = spark.range(4_000).selectExpr("id AS doc_id", f"concat_ws(' ', sha1(cast(id AS string)), CASE WHEN id % 5 < 4 THEN '{passage}' ELSE 'none' END) AS text").repartition(8)
        text = F.col("text")
        _, spans = substrings.repeated_spans(docs.select(F.col("doc_id").alias("id"), text, substrings.text_key("text").alias("tid")), substrings.WINDOW, substrings.SEED)
        sizes = [r.n for r in spans.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("doc")).collect()]
        assert sum(sizes) >= 3_200 and max(sizes) < sum(sizes) / 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_restores_records(spark, tmp_path):
    """Through the store of the query's own path, every record comes back as write() writes it, revisits too."""
    own = [(5, "abc"), (3, "abc"), (9, None), (1, ""), (8, "\u00e9\n\n"), (10, "abc"), (None, "abc"), (None, "q"), (7, "x\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n")]
    df = spark.createDataFrame([(p, "http://a/\u2028WARC-Record-ID: <urn:page:4>", h) for p, h in own], "page_id long, url string, html string")
    written = sorted(bytes(r.header) + (b"" if r.record_type == "revisit" else bytes(r.payload)) + b"\r\n\r\n" for r in warc.read(spark, warc.write(df, str(tmp_path / "w"))).collect())
    back = warc.restore(spark, warc.store(df, str(tmp_path / "s")))
    records = [bytes(r.record) for r in back.collect()]
    assert sorted(records) == written and len(list(warc.parse(records))) == len(own)
    assert warc.read(spark, str(tmp_path / "s/payloads")).count() == len({h or "" for _, h in own})
    found = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.described(back).collect()}
    assert {(3, 3, "response", None), (5, 3, "revisit", 3), (None, 3, "revisit", 3), (None, 1, "response", None), (9, 0, "revisit", 1)} <= found


def test_mixing(spark, sf_dir, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = [tuple(r) for r in queries.op2_mixing(spark, sf_dir).collect()]
    assert sorted(found) == sorted(con.execute(mixing.ORACLE).fetchall())
    data = [(i, "w " * (i % 7 + (400 if i == 50 else 0)), None if i % 5 == 0 else f"s{i % 4}") for i in range(60)] + [(None, None, "zz"), (3, "a b", "s1")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mixed(df).collect()
    target = brute.mix([len(brute.WORD.findall(t or "")) for _, t, _ in data], [s for _, _, s in data])
    assert len(out) == len(data) and all(abs(r.target - target[r.source]) < 1e-6 for r in out)
    assert all(r.taken <= 3 * r["size"] for r in out)
    same = spark.createDataFrame([(None, "one two three four five", "a", "x")] * 50 + [(i, "w " * 40, "b", "y") for i in range(40)], "doc_id long, text string, source string, `copies` string")
    for most, salts in ((50_000, 32), (0, 4)):
        monkeypatch.setattr(mixing, "MOST_SENT", most)
        monkeypatch.setattr(mixing, "SALTS", salts)
        taken = {s: (sum(r.taken for r in rows), rows[0].target) for s, rows in {s: [r for r in mixing.mixed(same).collect() if r.source == s] for s in "ab"}.items()}
        assert all(abs(n - t) <= (5 if s == "a" else 40) for s, (n, t) in taken.items())
        back = mixing.materialise(same).collect()
        assert all(sum(len(brute.WORD.findall(r.text)) for r in back if r.source == s) == taken[s][0] for s in "ab")
    again = mixing.materialise(df)
    assert again.columns == df.columns and again.count() == sum(r.copies for r in out)
    assert mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard(docs, rows, n, num, den):
    assert {tuple(r) for r in jaccard.join(docs, n=n, num=num, den=den).select("doc_id", "n_shingles", "component_id").collect()} == brute.components(rows, n, num, den)


def test_jaccard_near_copies(spark, monkeypatch):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    own = [(i + 100, " ".join(w if rng.random() > 0.004 else w.upper() + str(rng.randint(0, 9)) for w in base)) for i in range(120)] + ODD
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", 0.1)
    df = frame(spark, own)
    assert {tuple(r) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()} == brute.components(own, 3, 9, 10)
    twice = frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D"), (1, "q r s t u")])
    kept = jaccard.keep_one(twice)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d"), (1, "q r s t u")] and kept.columns == twice.columns
    assert jaccard.join(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = spark.range(700).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(2001, 2000), (2000, 2002)], "a long, b long"))
    assert {(r.node, r.root) for r in jaccard.components(edges, most=16).select("node", "root").collect()} == {(i, 0) for i in range(701)} | {(2000, 2000), (2001, 2000), (2002, 2000)}


def test_quality(spark, docs, rows):
    shout, lines = " ".join(f"LOUD{i} WORDS" for i in range(20)), "\n".join(f"one line {i % 6} of some words" for i in range(12))
    own = rows + [(10_000 + i, t) for i, t in [*ODD, (90, shout), (91, lines), (92, "a " * 5 + " ".join("bcdefghij")), (93, " ".join(f"# {i}" for i in range(20)))]] + [(None, "a b c")]
    text = dict(own)
    for r in quality.quality(frame(spark, own)).collect():
        counts = brute.quality(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r.kept == brute.kept(text[r.doc_id]) and (r.rejected_by is None) == (r.kept or r.base_failed)
    found = {x["name"]: x for x in quality.estimate(docs, quality.BASE_RULES + quality.OWN_RULES)}
    assert len(found) == len(quality.BASE_RULES + quality.OWN_RULES)
    assert found["repeated_words"]["seconds"] > max(found[x]["seconds"] for x in ("symbols", "too_few_words"))
    assert quality.keep_clean(docs).columns == docs.columns
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_keeps_clean_documents(spark, sf_dir):
    """Of the labelled documents that pass the base, none of quality 1 is rejected."""
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    found = quality.quality(labelled).filter("not base_failed").collect()
    assert len(found) > 10 and [r.doc_id for r in found if not r.kept] == []
    header, body = "A header of some ten words that stands here twice", " ".join(f"word{i}" for i in range(100))
    twice = frame(spark, [(1, f"{header}\n{body}\n{header}")])
    assert [(r.base_failed, r.rejected_by) for r in quality.quality(twice).collect()] == [(False, None)]
    lines = spark.createDataFrame([(3, "\n".join(f"yes{i % 3} no" for i in range(20)))], SCHEMA)
    assert [x.rejected_by for x in quality.cascade(lines, [r for r in quality.OWN_RULES if r.name == "equal_lines"]).collect()] == ["equal_lines"]


def test_tokens(spark, docs):
    import public_tokenizers as P

    for n in (1, 2, 3, 17, 4097):
        assert sorted(tokens.permute(np.arange(n), n, 7)) == list(range(n))
    path, own = P.path("byte_bpe_50k.tiktoken"), [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in ODD]
    coder, expected = tokens.encoding(path, P.PATTERN), {}
    for i, t in own:
        for j, x in enumerate(brute.sequences(coder.encode_ordinary(t or ""), 50_256)):
            expected[i, j] = hashlib.sha256(x.tobytes()).hexdigest()
    found = tokens.materialise(frame(spark, own), path, P.PATTERN, shard=500).collect()
    assert {(r.doc_id, r.seq): r.ids_sha256 for r in found} == expected
    assert sorted(r.slot for r in found) == list(range(len(expected)))
    assert tokens.materialise(docs.limit(0), path, P.PATTERN).count() == 0
    again = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]
    found = tokens.materialise(frame(spark, again), path, P.PATTERN).collect()
    assert sorted(r.slot for r in found) == [0, 1, 2, 3] and sorted(str(r.doc_id) for r in found) == ["1", "1", "None", "None"]


def test_tokens_resume(spark, docs, tmp_path):
    import public_tokenizers as P

    index = tokens.write(docs, str(tmp_path / "o"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shard=100)
    assert [r.slot for r in tokens.read(spark, str(tmp_path / "o"), 250, shard=100).orderBy("slot").collect()] == list(range(250, index.count()))


def test_licenses(spark, rows):
    own = rows + [(10_000 + i, t) for i, t in ODD]
    text = dict(own)
    for r in licenses.scan(frame(spark, own)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licenses.brute_force(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    extra = spark.createDataFrame([(1, "Released under the BSD license."), (2, "Licensed under CC BY-NC 4.0."), (3, "the driver license of the dog")], SCHEMA)
    assert {r.doc_id: r.labels for r in licenses.scan(extra).collect()} == {1: "bsd", 2: "cc-by-nc-4.0", 3: ""}
    assert licenses.scan(extra.limit(0)).count() == 0


def test_licenses_of_one_file(spark):
    """No template depends on what else the file holds: an uncapped brute force, every template word voting."""
    notices = [t for _, t, _ in licenses.TEMPLATES[:23]]
    four = ". ".join([notices[1], notices[14], "Subject to the terms of the Mozilla Public License, v. 2.0", notices[18]])
    prose = "The charge of a copy was granted with attribution to a universal domain of public creative mozilla files. " * 3
    rng = random.Random(3)
    own = [(1, four), (2, prose + "Released under the BSD license."), (3, f"{prose} ".join(notices)), (4, prose)]
    own += [(i, " ".join(rng.choice([prose, *notices]) for _ in range(rng.randint(1, 9)))) for i in range(5, 60)]
    expected = {i: brute.licenses(t, licenses.TEMPLATES) for i, t in own}
    assert expected[1] == "bsd,mit,mpl-2.0,unlicense" and expected[2] == "bsd" and expected[4] == ""
    assert {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(own, SCHEMA)).collect()} == expected


def test_licenses_of_whole_texts(spark):
    """Each template's own text, wrapped and punctuated, has its label; the first clauses alone don't make a BSD licence of three."""
    texts = ["/* " + ", ".join(t.capitalize() for t in notice.split(" the ")).replace(", ", " the\n * ") + ". */" for _, notice, _ in licenses.TEMPLATES]
    own = list(enumerate([*texts, "An origin of this software. Redistribution, and use in source: and binary forms!", "In no event will the authors be late."]))
    found = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(own, SCHEMA)).collect()}
    assert all(label in found[i] for i, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert {i: ",".join(sorted(x)) for i, x in found.items()} == {i: brute.licenses(t, licenses.TEMPLATES) for i, t in own}
    assert found[len(texts)] == {"bsd"} and found[len(texts) + 1] == {""}
    assert all("bsd-3-clause" not in found[i] for i, (label, _, _) in enumerate(licenses.TEMPLATES) if label == "bsd-2-clause")


def test_licenses_broken_anywhere(spark):
    """Each template's text with a line break, two blanks or a comment mark between any two words has its label; so has each base phrase."""
    own = [(len(licenses.TEMPLATES) * k + i, notice.replace(" ", gap)) for k, gap in enumerate((" \n", "  ", "\n * ", "-")) for i, (_, notice, _) in enumerate(licenses.TEMPLATES)]
    found = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(own, SCHEMA)).collect()}
    assert all(licenses.TEMPLATES[i % len(licenses.TEMPLATES)][0] in found[i] for i, _ in own)
    words = {w for p, _ in licenses.BASE for w in p.split()}
    assert set(licenses.signs()) & words and all(set(licenses.signs()) & {w for k in keys for w in k.split()} for _, _, keys in licenses.TEMPLATES)
    spdx = [(1, "// SPDX-License-Identifier: GPL-3.0-only"), (2, "# SPDX-License-Identifier: Apache-2.0"), (3, "driver-license identifier")]
    assert {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(spdx, SCHEMA)).collect()} == {1: "gpl-3.0", 2: "apache-2.0", 3: ""}


def test_licenses_phrases_in_place(spark):
    gpl = "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation"
    own = {
        "Licensed under the GNU General Public License, version 2. See the notes of plugin version 3 below.": "gpl,gpl-2.0",
        "Licensed under the Apache License. The tool needs version 2.0 of make.": "apache",
        "Version 2.0 of make. " + "word " * 50 + "Licensed under the Apache License.": "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache,apache-2.0",
        "Licensed under the GNU General Public License (GPL), version 3.": "gpl,gpl-3.0",
        "GNU General Public License, either version 2": "gpl,gpl-2.0",
        f"{gpl}, either version 3 of the License, or (at your option) any later version. It needs version 2 of make.": "gpl,gpl-3.0",
        f"{gpl}; version 2 of the License.": "gpl,gpl-2.0",
        "GNU General Public License, version 2 or version 3": "gpl,gpl-2.0,gpl-3.0",
        "GNU General Public License, version 2. The old GNU General Public License, version 3": "gpl,gpl-2.0,gpl-3.0",
    }
    rows = list(enumerate(own))
    assert {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: own[t] for i, t in rows}


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    out = language.identify(docs).collect()
    held = [r for r in out if r.held_out and known[r.doc_id]]
    assert len(out) == len(known) and sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en", 1.0), (2, "12 !!", "en", 1.0), (None, "the of", None, 1.0), (4, "x", "fr", 2.0)], "doc_id long, text string, lang string, score double")
    assert {r.doc_id: r.lang_pred for r in language.identify(odd).collect() if r.doc_id in (1, 2)} == {1: "und", 2: "und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_language_of_few_texts(spark):
    """Fifteen texts a language, two of three bytes a letter; ties, repeated rows and an empty text."""
    words = {"el": "και το νερο στην πολη ειναι καλο σημερα", "ru": "и вода в городе сегодня хорошая очень", "hi": "पानी शहर में आज अच्छा है और", "ja": "みずはまちできょうよいですとても"}
    rng, own = random.Random(4), []
    for lang, w in words.items():
        parts = w.split() if " " in w else [w[i:i + 3] for i in range(0, len(w), 3)]
        own += [(len(own) + i, " ".join(rng.choice(parts) for _ in range(60)), lang) for i in range(30)]
    own += [(1000, own[0][1], "el"), (1000, own[0][1], "el"), (1001, "", "ru"), (1002, own[40][1], None)]
    out = language.identify(spark.createDataFrame(own, "doc_id long, text string, lang string")).collect()
    known = {i: lang for i, t, lang in own if t and lang}
    assert len(out) == len(own) and all(r.lang_pred == known[r.doc_id] for r in out if r.doc_id in known)
    assert {r.lang_pred for r in out if r.doc_id == 1001} == {"und"}


def test_language_gradients():
    m = language.new_model(["a", "b", "c"], 4)
    rng = np.random.default_rng(0)
    codes, mask, of = rng.integers(97, 100, (7, 5)).astype(np.uint8), np.ones((7, 5, 1), np.float32), np.array([0, 1, 2, 0, 1])
    mask[4:, 2] = 0
    _, grads = language.step(m, codes, mask, of)
    for x, g in zip(m.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = x[at]
        x[at] = old + 0.01
        up = language.step(m, codes, mask, of)[0]
        x[at] = old - 0.01
        down = language.step(m, codes, mask, of)[0]
        x[at] = old
        assert abs(g[at] - (up - down) / 0.02) < 2e-3


def test_neighbours(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in neighbours.search(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit, total = hit + len(best & found[ids[i]]), total + len(best)
    assert hit >= 0.9 * total
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (20, [2.0, 1.0]), (5, [2.0, 1.0]), (4, [2.0, 1.0]), (None, [1.0, 1.0]), (6, [1.0, None]), (7, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours.search(odd).orderBy("query_id", "rank").collect()] == [(0, 4), (0, 5), (0, 20), (20, 4), (20, 5), (20, 0)]
    assert neighbours.search(odd.limit(0)).count() == 0


def test_neighbours_that_stop(spark, monkeypatch):
    """Clusters over several cells and blocks: under half of all pairs are verified, and nine in ten neighbours found."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32)) * 4
    vectors = centres[rng.integers(0, 40, 4_000)] + rng.standard_normal((4_000, 32)) * 0.5
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    vectors[:900] = vectors[0]  # one very frequent vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    found = {}
    for r in neighbours.search(df).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for i in range(0, 4_000, 20):
        score = (vectors * vectors[i]).sum(axis=1)
        score[i] = -np.inf
        own = sorted(found[i])
        assert [x[0] for x in own] == list(range(1, 21)) and all(abs(score[j] - s) < 1e-12 for _, j, s in own)
        hit, total = hit + sum(s >= np.sort(score)[-20] - 1e-12 for _, _, s in own), total + 20
    assert hit >= 0.9 * total
    assert neighbours.verified_share(df) < 0.5
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (20, [1.0]), (21, [3.0]), (22, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours.search(two).orderBy("query_id", "rank").collect()] == [(0, 1), (20, 21), (20, 22)]


def test_bpe(spark, rows):
    from tokenizers import Tokenizer

    path = queries.word_bpe_path()
    library, own = Tokenizer.from_file(path), rows + [(10_000 + i, t) for i, t in ODD]
    text = dict(own)
    for r in bpe.digests(frame(spark, own), path).collect():
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))
    ours = bpe.Bpe(path)
    for x in ["İstanbul ẞ Σίσυφος ΟΔΟΣ", "日本語 ①²½", *[f"a{chr(i)}b{chr(i)}1" for i in range(0x300)]]:
        assert np.frombuffer(ours.encode(x, {}), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize(("seed_places", "edge_places"), [(20_000, 100_000), (20_000, 4), (3, 4)])
def test_substrings(spark, rows, monkeypatch, seed_places, edge_places):
    monkeypatch.setattr(substrings, "HOT_SEED", seed_places)
    monkeypatch.setattr(substrings, "HOT_EDGE", edge_places)
    rng = random.Random(2)
    parts = [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(3)]
    made = [(i, " ".join(rng.choice(parts) if rng.random() < 0.5 else " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(5))) for i in range(40)]
    made += [(None, None), (1, "x " * 80), (1, "x " * 80), (None, "y " * 34), (7, "z " * 36), *ODD]
    for own in (rows, made):
        df = frame(spark, own)
        found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substrings(df).collect()), key=str)
        assert found == sorted(((i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.without_repeats(own)), key=str)
    assert substrings.substrings(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """A text of millions of words with one huge word, through every operator on texts; each whole."""
    import public_tokenizers as P

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(5_000)]
    long = " ".join(rng.choice(words) for _ in range(700_000)) + " " + "x" * 3_000_000 + " tail of the mit license"
    near = long.replace(" tail of", " end of")
    own = [(1, long, "en", "a"), (2, near, "en", "b"), (3, "a short text of the mit license in some ten words", "en", "a")]
    df = spark.createDataFrame(own, "doc_id long, text string, lang string, source string").repartition(3)
    n = len(long.split())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == {i: (s, c) for i, s, c in brute.components([r[:2] for r in own], 3, 9, 10)}
    assert {r.doc_id: r.n_words for r in quality.quality(df).collect()} == {1: n, 2: n, 3: 11}
    assert {r.doc_id: r.last_word for r in licenses.scan(df).collect()} == {1: n - 2, 2: n - 2, 3: 5}
    assert {r.doc_id: r["size"] for r in mixing.mixed(df).collect()} == {1: n, 2: n, 3: 11}
    cut = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substrings(df).collect()}
    assert cut == {i: (k, gone, brute.sha(kept)) for i, k, gone, kept in brute.without_repeats([r[:2] for r in own])}
    coder = tokens.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    some = df.filter("doc_id > 1").withColumn("text", F.expr("CASE WHEN doc_id = 2 THEN concat(substr(text, 1, 2000000), repeat('y', 5000)) ELSE text END"))
    count = {r.doc_id: r.n for r in tokens.materialise(some, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert count == {r.doc_id: len(coder.encode_ordinary(r.text)) for r in some.collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.word_bpe_path())
    found = {r.doc_id: r.ids_sha256 for r in bpe.digests(some, queries.word_bpe_path()).collect()}
    assert found == {r.doc_id: hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest() for r in some.collect()}
    assert {r.lang_pred for r in language.identify(some).collect()} == {"en"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, df = con.execute(queries.ORACLE[name]), queries.QUERIES[name](spark, sf_dir)
    order = [c[0] for c in found.description]
    assert sorted(order) == sorted(df.columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(tuple(r) for r in df.select(*order).collect()) == plain(found.fetchall())
