"""Content-addressed WARC archive.

A store has two parts. ``payloads`` holds WARC files with one record per distinct payload: its bytes once,
named by their SHA-256. ``headers`` holds, for every record, its exact header bytes, its digests and what it
refers to. Joining the two by that key gives back any original record, byte by byte. Records with a payload
that another record holds are ``revisit`` records that refer to the one with the smallest id.

The files are plain WARC/1.1, gzip-compressed as a whole, written and read by Spark's own text and binary
file sources, so that any file system Spark knows will do. A record ends in CR LF CR LF, which is the line
separator of the text sink; payload bytes go through it unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions_at_least, release, staged

#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
#: Records of one file at most, and bytes that it should hold: a file is read as one row.
RECORDS_PER_FILE, FILE_BYTES = 2_000, 64 << 20
DATE = "1970-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_READ = "page_id string, record_type string, digest string, key string, refers_to string, header binary, payload binary"


def base32_sha1(data):
    """Bare upper-case base32 of a binary column's SHA-1, native.

    40 hexadecimal digits are 8 groups of 5 digits, each of 20 bits or 4 base-32 digits.
    """
    code = F.lit(_BASE32)
    hexa = F.sha1(data)
    out = []
    for g in range(8):
        n = F.conv(F.substring(hexa, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(code, F.shiftright(n, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _clean(value):
    """A header value stands on one line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """One row per input row: page_id, url, payload, its bytes n, digest (SHA-1), key (SHA-256), record_type, refers_to.

    Payloads count as equal by their SHA-256. A null payload is empty. Payloads of fewer than ``least`` bytes are never deduplicated. Among equal
    payloads the record of the smallest id is the response; rows that repeat its id are responses too.
    A null id sorts last: such a record is a response only where no record of that payload has an id.

    The digests are grouped without the payloads; a hot payload is pre-aggregated in each task. What comes of it is written before
    it is joined: both sides are plain tables then, and adaptive execution may split the rows of a hot payload.
    """
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("key", F.sha2("payload", 256)).withColumn("n", F.length("payload").cast("long"))
    first = staged(rows.filter(F.col("n") >= least).groupBy("key").agg(F.min("page_id").alias("first_id")), "first-ids")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.join(first, "key", "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first_id")))
        .drop("first_id")
    )


#: What an id of text may not hold inside a record's id, and how it is written there; undone in the other order.
_ESCAPES = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\r", "%0D"), ("\n", "%0A"))


def _record_id(of):
    text = of.cast("string")
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.coalesce(F.concat(F.lit("<urn:page:"), text, F.lit(">")), F.lit("<urn:none>"))


def header():
    """The record's header block as text, from the columns of :func:`records`; it ends before the empty line."""
    revisit = F.col("record_type") == "revisit"
    return F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Key: sha256:"), F.col("key")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n")).cast("string")),
    )


def _put(rows: DataFrame, path: str) -> None:
    """Write the binary column ``record``, less its END, as gzip-compressed WARC files."""
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> str:
    """Write one WARC record per row under ``path``; a revisit's block is empty, its payload is its response's."""
    rows = records(df, id_col, url_col, payload_col, least)
    head = F.concat(header(), F.lit(END)).cast("binary")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    _put(rows.select(F.concat(head, block).alias("record")), path)
    return path


def _gunzip(data: bytes):
    """Pieces of a gzip file's content, member after member."""
    while data:
        z = zlib.decompressobj(31)
        out = z.decompress(data, 1 << 20)
        while out or not z.eof:
            yield out
            if not z.unconsumed_tail and not z.eof:
                rest = z.flush()
                if rest:
                    yield rest
                break
            out = z.decompress(z.unconsumed_tail, 1 << 20)
        data = z.unused_data


def parse(pieces):
    """(header bytes, payload bytes) of each record, from pieces of a file; holds one record at a time."""
    held, source, at = bytearray(), iter(pieces), 0

    def need(n: int) -> bool:
        while len(held) - at < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    def upto(mark: bytes) -> int:
        seek = at
        while (k := held.find(mark, seek)) < 0:
            seek = max(at, len(held) - len(mark) + 1)
            if not need(len(held) - at + 1):
                raise ValueError("a record's header has no end")
        return k

    while need(1):
        end = upto(b"\r\n\r\n")
        head = bytes(held[at:end + 4])
        found = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", head)
        if not head.startswith(b"WARC/") or not found:
            raise ValueError(f"not a WARC record: {head[:60]!r}")
        size = int(found[1])
        at = end + 4
        if not need(size + 4) or held[at + size:at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield head, bytes(held[at:at + size])
        at += size + 4
        if at > 1 << 20:
            del held[:at]
            at = 0


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def _page(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    text = found[1] if found else None
    for plain, written in reversed(_ESCAPES if text else ()):
        text = text.replace(written, plain)
    return text


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files under ``path``: page_id, record_type, digest, refers_to, exact header and payload.

    A response's digests are worked out anew and must equal those in its header. A folder of no files gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _READ.split(", ")]
        schema = pa.schema([(n, pa.binary() if n in ("header", "payload") else pa.string()) for n in names])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, payload in parse(_gunzip(content.as_py())):
                    kind, digest = _field(head, "WARC-Type"), (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                    key = (_field(head, "X-Payload-Key") or "").removeprefix("sha256:")
                    if (kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest) or (kind != "revisit" and hashlib.sha256(payload).hexdigest() != key):
                        raise ValueError(f"payload of {_field(head, 'WARC-Record-ID')} doesn't have its digests")
                    rows.append((_page(_field(head, "WARC-Record-ID")), kind, digest, key, _page(_field(head, "WARC-Refers-To")), head, payload))
                    held += len(payload) + len(head)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return files.mapInArrow(run, _READ)


def _store(heads: DataFrame, payloads: DataFrame, path: str) -> str:
    """``payloads`` (key, payload) as WARC records named by their key, each key once; ``heads`` as a table.

    The payloads' bytes, copies included, say how many files they may need.
    """
    spark = heads.sparkSession
    size = payloads.agg(F.sum(F.length("payload").cast("long"))).first()[0] or 0
    name = F.concat(F.lit("urn:sha256:"), F.col("key"))
    head = F.concat_ws(
        "\r\n", F.lit(VERSION), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <"), name, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), name), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("X-Payload-Key: sha256:"), F.col("key")), F.lit("Content-Type: application/octet-stream"), F.concat(F.lit("Content-Length: "), F.length("payload").cast("string")),
    )
    with partitions_at_least(spark, size // FILE_BYTES + 1):
        _put(payloads.dropDuplicates(["key"]).select(F.concat(F.concat(head, F.lit(END)).cast("binary"), F.col("payload")).alias("record")), f"{path}/payloads")
    heads.select("page_id", "record_type", "digest", "key", "refers_to", "header").write.parquet(f"{path}/headers")
    release(spark)
    return path


def split_store(found: DataFrame, path: str) -> str:
    """Write a content-addressed store of records that were read: payloads once each, headers one row per record."""
    return _store(found, found.filter(F.col("record_type") == "response").select("key", "payload"), path)


def store(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> str:
    """Write the rows as a content-addressed store; the headers are made without the payloads being moved."""
    rows = records(df, id_col, url_col, payload_col, least)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return _store(rows.withColumn("header", F.concat(header(), F.lit(END)).cast("binary")), df.select(F.sha2(payload, 256).alias("key"), payload.alias("payload")), path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Original records of a store through a join by key: page_id, exact header, full payload, and the record's exact bytes.

    A revisit's record holds no payload, as it was written. A header without its payload is an error.
    """
    heads, held = spark.read.parquet(f"{path}/headers"), read(spark, f"{path}/payloads").select("key", "payload")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return (
        heads.join(held, "key", "left")
        .withColumn("payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload of key "), F.col("key"))).cast("binary")))
        .select("page_id", "record_type", "header", "payload", F.concat("header", block, F.lit(END.encode())).alias("record"))
    )


def described(restored: DataFrame, id_type: str = "long") -> DataFrame:
    """Per restored record, from its header and payload: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest is worked out from the restored payload, a revisit's too, and must equal the one in the header;
    Content-Length must be the length of the record's block.
    """
    head = F.col("header").cast("string")

    def field(name: str, value: str):
        return F.regexp_extract(head, rf"(?md)^{name}: {value}\r$", 1)

    def page(name: str):
        of = field(name, "<([^\\r\\n]*)>")
        text = F.when(of.startswith("urn:page:"), F.substr(of, F.lit(len("urn:page:") + 1)))
        for plain, written in reversed(_ESCAPES):
            text = F.replace(text, F.lit(written), F.lit(plain))
        return text.cast(id_type)

    digest = base32_sha1(F.col("payload"))
    block = F.length("record") - F.length("header") - F.lit(len(END))
    sound = (digest == field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")) & (block.cast("string") == field("Content-Length", "([0-9]+)"))
    return restored.select(
        page("WARC-Record-ID").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, digest).otherwise(F.raise_error(F.concat(F.lit("a record isn't as it was written: "), head))).alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    )


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write the rows as a content-addressed store into the shared folder, restore every record and describe it.

    Null payloads are empty ones; null ids sort last; repeated ids and rows, ties and payloads of any length up to
    what a row holds are as in :func:`records`. Further columns of any name are ignored. An empty table gives no rows.
    """
    path = store(df, new_path(df.sparkSession, "warc"), id_col, url_col, payload_col, least)
    return described(restore(df.sparkSession, path), dict(df.dtypes)[id_col])
