"""The queries of this subpackage that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from . import mixing

_ALPHABET, _BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WORD = r"[^\x20\x09-\x0D]+"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', ((('0x' || substr(sha1(h), (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS win FROM w WHERE len(w) > 4)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM v WHERE c > 1) GROUP BY doc_id),
of_lines AS (SELECT doc_id, sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS again FROM (SELECT doc_id, len(regexp_extract_all(x, '{_WORD}')) AS n, row_number() OVER (PARTITION BY doc_id, x) AS k FROM (SELECT doc_id, unnest(lines) AS x FROM w)) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(again, 0) AS again,
  length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS capitals, length(t) - length(regexp_replace(t, '\\p{{L}}+', '', 'g')) AS letters
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN of_lines o ON w.doc_id = o.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  AND NOT (10 * n_symbols > 3 * n_words OR (n_dup_lines > 0 AND 10 * again > 3 * n_words) OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * capitals > letters) AS kept
FROM b"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS win FROM w WHERE len(w) > 34)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM v WHERE c > 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
left_ AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w) x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN left_ ON w.doc_id = left_.doc_id"""



def _crc_table() -> str:
    """The 256 entries of CRC-32, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return "[" + ",".join(map(str, out)) + "]::BIGINT[]"


_FEATURES = r"""SELECT doc_id, w, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
  FROM (SELECT {key} AS doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table})"""

RESAMPLING = f"""
WITH d AS ({_FEATURES.format(key='doc_id', table='documents', upper=_ALPHABET, lower=_ALPHABET.lower())}),
g AS ({_FEATURES.format(key='0', table='benchmark', upper=_ALPHABET, lower=_ALPHABET.lower())}),
df AS (SELECT doc_id, unnest(f) AS x FROM d), gf AS (SELECT unnest(f) AS x FROM g),
tab AS (SELECT {_crc_table()} AS t),
names AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM df UNION SELECT x FROM gf)),
b AS (SELECT x, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS k FROM names, tab),
s AS (SELECT k, count(*) AS n FROM df JOIN b ON df.x = b.x GROUP BY k), t AS (SELECT k, count(*) AS n FROM gf JOIN b ON gf.x = b.x GROUP BY k),
gain AS (SELECT r.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM gf) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(0, 10000) r(k) LEFT JOIN s ON r.k = s.k LEFT JOIN t ON r.k = t.k),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM df JOIN b ON df.x = b.x JOIN gain ON b.k = gain.k GROUP BY doc_id),
z AS (SELECT d.doc_id, d.n_words, coalesce(m.n, 0)::BIGINT AS n_features, coalesce(m.weight, 0)::BIGINT AS weight,
  coalesce(m.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_words >= 20)
SELECT z.doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM z LEFT JOIN o ON z.doc_id = o.doc_id"""

ORACLE = {"op1_warc": WARC, "op2_mixing": mixing.ORACLE, "op3_jaccard": JACCARD, "op4_quality": QUALITY, "op10_substrings": SUBSTRINGS, "op11_resampling": RESAMPLING}
