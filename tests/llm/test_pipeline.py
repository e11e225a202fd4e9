"""The pipeline on a small fixture against the plain versions of its stages."""

import hashlib
import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import mixing, queries
from graphloom.llm.common import staged

from . import brute


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(60)
    rows = [(i, f"{text(60)} {shared if i % 7 == 0 else text(20)} {text(40)}", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)] + [(200 + i, rows[i + 20][1] + " more", "en", "s1") for i in range(5)]
    rows += [(300, "too short", "en", "s1"), (301, "### " * 50, "en", "s1"), (302, None, None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs, columns = df, df.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        assert name == "token_ids" or docs.columns == columns
    kept = {r.doc_id for r in seen["quality_rules"].collect()}
    assert kept == {i for i, *_ in rows} - {300, 301, 302}
    left = [(r.doc_id, r.text) for r in seen["quality_rules"].collect()]
    one = {i for i, _, c in brute.components(left, 5, 4, 5) if i == c}
    assert {r.doc_id for r in seen["near_copies"].collect()} == one
    before = [(r.doc_id, r.text) for r in seen["near_copies"].collect()]
    cut = {i: (gone, body) for i, _, gone, body in brute.without_repeats(before)}
    after = {r.doc_id: r.text for r in seen["repeated_passages"].collect()}
    assert after == {i: cut[i][1] if cut[i][0] else t for i, t in before}
    mixed = seen["mix_sources"].collect()
    assert all(after[r.doc_id] == r.text for r in mixed)
    target = brute.mix([len(brute.WORD.findall(r.text or "")) for r in seen["repeated_passages"].collect()], [r.source for r in seen["repeated_passages"].collect()])
    longest = max(len(brute.WORD.findall(t or "")) for t in after.values())
    for source, n in target.items():
        assert abs(sum(len(brute.WORD.findall(r.text or "")) for r in mixed if r.source == source) - n) <= longest
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: r.copies for r in mixing.mixed(seen["repeated_passages"]).collect() if r.copies})
    library = Tokenizer.from_file(queries.word_bpe_path())
    expected = Counter((r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()) for r in mixed)
    found = seen["token_ids"].collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == expected
    assert all(r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in found)


def test_stages_on_odd_tables(spark, tmp_path):
    """An empty table, further and clashing columns, null and repeated ids, repeated rows."""
    text = " ".join(f"word{i} stands here" for i in range(20))
    rows = [(None, text, "en", "a"), (None, text, "en", "a"), (1, text + " x", "en", None), (1, "quite another text of more than ten words is standing right here today", None, "a"), (1, "quite another text of more than ten words is standing right here today", None, "a"), (2, None, None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tid int, _kept_text int, `a.b` int")
    for own in (df, df.limit(0)):
        docs = own
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, str(tmp_path)), name)
            assert name == "token_ids" or docs.columns == df.columns
            if name == "near_copies" and own is df:
                assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted([(1, rows[2][1]), (1, rows[3][1])])
        assert (docs.count() > 0) == (own is df)


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256"] and found.count() > 0
