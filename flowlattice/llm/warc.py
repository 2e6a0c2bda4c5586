"""WARC archives of pages: writing, reading, and putting transactions together again.

A page becomes three records: request, response (or revisit) and metadata.  Request and
metadata name the response in WARC-Concurrent-To.  Of pages with equal payloads of at least
``least`` bytes, the one with the largest page_id is the response; the others are revisits,
without payload, that name its record in WARC-Refers-To.

Archives are gzip files of WARC/1.1 records in the shared folder, written by Spark's text
writer (a record ends in two line ends, which is the writer's line separator) and so safe
against lost tasks.  Reading takes each file whole, so a file holds about ``FILE_BYTES`` at most:
pages are written in classes of size, each with so many records a file.  Records are parted by
their Content-Length alone.

Assembling joins requests and metadata to responses by the identifiers, giving one nested row
per capture, and looks up what a revisit's full payload was at the response it refers to.

The pages are read once: a first pass writes them, with digests and sizes, by class of size; copies are
found in the narrow columns of that, and each class is read from its own part.

Edge cases: a null html is an empty payload.  A null url is empty; each control character and blank in
it is percent-encoded.  A page_id may be of any type that casts to and from text.  Pages that repeat page_id and payload share their records' names; each
gives one capture, a response where its page_id is the largest.  A null page_id is smaller
than any other; if all of a payload's are null, all are responses.  No pages: no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.functions.materialise import discard
from flowlattice.llm.common import BROADCAST_ROWS, shared_dir, written

#: Bytes of an archive file before compression, about, and the largest payload of each class of pages (the last has the rest).
FILE_BYTES, CLASSES = 64_000_000, (20_000, 300_000, 5_000_000)
#: Pages have no date, so all records have this one.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
#: Characters that cannot stand in a header's address.
_CONTROL = r"[\x00-\x20\x7F]"
#: Digits of base 32 as Spark's conv writes them, and as RFC 4648 does.
_CONV, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits make 8 digits."""
    parts = [F.translate(F.lpad(F.conv(F.substring(F.sha1(data), 10 * i + 1, 10), 16, 32), 8, "0"), _CONV, _RFC) for i in range(4)]
    return F.concat(*parts)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, i, n), F.lit("-" if i < 21 else ">"))))


def _record(kind: Column, rid: Column, block: Column, fields: list[tuple[str, Column]]) -> Column:
    """A record but for the two line ends that close it; fields that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def staged(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, n, digest, class: written by class of size."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("class", _class(F.col("n")))
    return written(p, "pages", by="class")


def classified(p: DataFrame, least: int = 0) -> DataFrame:
    """staged() with keeper: the page of the response that a page's record revisits (null: none)."""
    # only payloads that occur again matter further on; most data has few
    again = p.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("largest"), F.count("*").alias("c"))
    again = written(again.where("c > 1").drop("c"), "payloads")
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    p = p.join(side, ["digest", "n"], "left")
    return p.withColumn("keeper", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("largest")), F.col("largest"))).drop("largest")


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes the archives of ``pages`` (page_id, url, html) to the folder ``path``."""
    stage = staged(pages)
    p = classified(stage, least)
    url = F.when(F.col("url").rlike(_CONTROL), F.array_join(F.transform(F.split("url", ""), lambda c: F.when(c.rlike(_CONTROL), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")).otherwise(F.col("url"))
    rid = _uuid(F.lit("response"), F.col("page_id"), F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    host, target = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(url, r"^(?:[a-zA-Z]+://[^/?#]*)?([^#]*)", 1)
    uri = ("WARC-Target-URI", url)
    first = F.col("keeper").isNull()
    response = _record(
        F.when(first, "response").otherwise("revisit"), rid, F.when(first, F.concat(head, "payload")).otherwise(head),
        [uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", F.lit("application/http; msgtype=response")),
         ("WARC-Profile", F.when(~first, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Refers-To", F.when(~first, _uuid(F.lit("response"), F.col("keeper"), F.col("digest"))))],
    )
    ask = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END))
    request = _record(F.lit("request"), _uuid(F.lit("request"), F.col("page_id"), F.col("digest")), ask, [uri, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request"))])
    notes = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.url_encode(F.col("page_id").cast("string")), F.lit(END)), F.lit("")), F.lit("via: pages"), F.lit(END))
    metadata = _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("page_id"), F.col("digest")), notes, [uri, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))])
    # three records a page; classes that no page is in are not written
    for c in sorted(r[0] for r in stage.select("class").distinct().collect()) or [0]:
        rows = p.where(F.col("class") == c).select(F.explode(F.array(request, response, metadata)).alias("value"))
        most = 3 * max(1, FILE_BYTES // CLASSES[c]) if c < len(CLASSES) else 3
        rows.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/class-{c}")
    discard(stage)


def _class(n: Column) -> Column:
    return sum((n > most).cast("int") for most in CLASSES)


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record should start here: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return head, body


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, digest_field string, fields string, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row a record.  Without ``payload`` only its size and digest are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for head, block in records_of(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(b.column("content")[i].as_py())), 1 << 20)):
                    kind = head["warc-type"]
                    body = split_http(block)[1] if kind == "response" else b""
                    own = kind == "response"
                    rows.append((head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest"), block.decode("utf-8", "replace") if kind in ("metadata", "request") else None, len(body) if own else None, base64.b32encode(hashlib.sha1(body).digest()).decode() if own else None, body if own and payload else None))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def assemble(records: DataFrame, page_type: str = "bigint") -> DataFrame:
    """One row a capture: record_id, page_id (of the given type), record_type, refers_to (a record), and the structs request, response, metadata."""

    def side(kind: str, fields: dict[str, str]) -> DataFrame:
        # records that repeat have one name and say the same
        own = records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id"))
        said = {name: F.regexp_extract("fields", rule, 1).alias(name) for name, rule in fields.items()}
        return own.agg(F.first(F.struct(F.col("record_id").alias("id"), "target_uri", *said.values(), "fields")).alias(kind))

    captures = records.where(F.col("type").isin("response", "revisit"))
    captures = captures.select("record_id", F.col("type").alias("record_type"), "refers_to", F.struct(F.col("record_id").alias("id"), "target_uri", "digest_field", "payload_bytes", "payload_digest", "payload").alias("response"))
    requests = side("request", {"method": r"^(\S+) ", "target": r"^\S+ (\S*) HTTP/", "host": r"\r\nHost: (\S*)\r\n"})
    out = captures.join(requests, "record_id", "left").join(side("metadata", {"via": r"(?:^|\r\n)via: ([^\r\n]*)"}), "record_id", "left")
    page = F.regexp_extract("metadata.fields", r"page-id: ([^\r\n]*)", 1)
    return out.withColumn("page_id", F.when(F.col("metadata.fields").contains("page-id: "), F.url_decode(page)).cast(page_type))


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes, reads and assembles: one nested row a capture.

    page_id, payload_bytes, payload_digest, record_type, refers_to, and the structs request (id, method, target, host),
    response (id, target_uri, digest_field) and metadata (id, via).
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path, least)
    records = written(read(spark, path, payload=False).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary"))
    parts = [F.struct(*(F.col(f"{kind}.{c}") for c in names)).alias(kind) for kind, names in (("request", ("id", "method", "target", "host")), ("response", ("id", "target_uri", "digest_field")), ("metadata", ("id", "via")))]
    own = written(assemble(records, pages.schema["page_id"].dataType.simpleString()).select("record_id", "page_id", "record_type", "refers_to", "response.payload_bytes", "response.payload_digest", *parts), "captures")
    to = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("t_id")).agg(F.max("page_id").alias("t_page"), F.first("payload_bytes").alias("t_bytes"), F.first("payload_digest").alias("t_digest"))
    to = written(to.join(own.where("record_type = 'revisit'").select(F.col("refers_to").alias("t_id")).distinct(), "t_id"), "referred")
    side = F.broadcast(to) if to.count() <= BROADCAST_ROWS else to
    out = own.join(side, own["refers_to"] == side["t_id"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "t_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "t_digest").alias("payload_digest"), "record_type", F.col("t_page").alias("refers_to"), "request", "response", "metadata")


def digests(pages: DataFrame) -> DataFrame:
    """captures() with the nested columns as one of JSON, and the method and target of the request and the target_uri of the response besides."""
    nested = F.to_json(F.struct("request", "response", "metadata"), {"ignoreNullFields": "false"})
    own = captures(pages)
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("response.target_uri").alias("target_uri"), F.col("request.method").alias("request_method"), F.col("request.target").alias("request_target"), nested.alias("capture"))


def oracle() -> str:
    """DuckDB SQL for digests()."""
    digits = " || ".join(f"substr('{_RFC}', 1 + (('0x' || substr(h, {5 * c + 1}, 5))::INTEGER >> {15 - 5 * k}) % 32, 1)" for c in range(8) for k in range(4))
    uuid = lambda kind: f"'<urn:uuid:' || regexp_replace(md5(concat_ws('|', '{kind}', coalesce(page_id::VARCHAR, 'null'), payload_digest)), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>'"
    return f"""
WITH p AS (SELECT page_id, array_to_string(list_transform(string_split(coalesce(url, ''), ''), lambda c: CASE WHEN regexp_matches(c, '{_CONTROL}') THEN printf('%%%02X', ascii(c)) ELSE c END), '') AS target_uri, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, {digits} AS payload_digest, regexp_extract(target_uri, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, regexp_extract(target_uri, '^(?:[a-zA-Z]+://[^/?#]*)?([^#]*)', 1) AS path, max(page_id) OVER (PARTITION BY h, n) AS top FROM p),
a AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS target FROM m)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, target_uri, 'GET' AS request_method, target AS request_target,
  to_json({{'request': {{'id': {uuid("request")}, 'method': 'GET', 'target': target, 'host': host}},
    'response': {{'id': {uuid("response")}, 'target_uri': target_uri, 'digest_field': 'sha1:' || payload_digest}},
    'metadata': {{'id': {uuid("metadata")}, 'via': 'pages'}}}})::VARCHAR AS capture
FROM a"""
