"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: the request, the response (or a revisit, if an equal
payload of some length is stored with another page) and metadata. Request and metadata
name the response in WARC-Concurrent-To; a revisit names the response that holds its
payload in WARC-Refers-To. Archives are written by Spark's text writer with the four
bytes that end a record as line separator, so they land wherever Spark can write.

The reader walks the records by their Content-Length, inside the tasks and a piece of
an archive at a time. Records meet through the concurrent-to identifiers in one
aggregation and give one nested row for each capture.

Defined results: a null page or url is a capture with an empty payload or without a
target; null ids are kept as null; pages with the smallest id among equal payloads are
all responses if several have that id; rows that repeat give equal records, which count
as copies and give a row each; an empty table gives an archive without records. Further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heirloom.session import materialize, scratch_path

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
END = CRLF + CRLF
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this are stored with every page.
LEAST_REVISIT = 100
#: What an archive holds at most, if all its payloads were as long as the longest one.
ARCHIVE_BYTES = 1 << 29
CHUNK = 1 << 20

FACTS = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "digest string, http string, fields string, payload_bytes bigint, payload_sha256 string, payload binary"
)


def _field(name: str, value: Column) -> Column:
    """A header line, or null where there is no value. A value stays on its line."""
    return F.concat(F.lit(f"{CRLF}{name}: "), F.regexp_replace(value, r"[\r\n]+", " "))


def _urn(*parts: Column) -> Column:
    """An identifier that depends on the parts alone."""
    text = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.regexp_replace(
        F.md5(text.cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>"
    )


def _record(kind: Column, of: Column, fields: list[Column], content_type: str, block: Column) -> Column:
    present = F.concat_ws("", _field("WARC-Type", kind), _field("WARC-Record-ID", of), *fields)
    length = F.octet_length(block).cast("string")
    head = F.concat(F.lit(VERSION), present, F.lit(f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), length)
    return F.concat(head, F.lit(END), block)


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)}
    )


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a capture of each page(page_id, url, html) below ``path``."""
    rows = _keyed(pages)
    seen = Observation(f"warc-{uuid.uuid4().hex}")
    # Digests and ids alone are grouped; payloads stay where they are unless many repeat.
    stored = materialize(
        rows.observe(seen, F.coalesce(F.max("bytes"), F.lit(0)).alias("longest"))
        .filter(F.col("bytes") >= LEAST_REVISIT)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min(F.struct("page_id", "url")).alias("any"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL"),
        "warc-repeats",
    )
    owner = rows.filter(F.col("bytes") >= LEAST_REVISIT).select("page_id", "url", "digest")
    owner = owner.join(stored.select("of", "first"), (F.col("of") == F.col("digest")) & (F.col("first") == F.col("page_id")))
    owner = materialize(
        owner.groupBy("of").agg(F.min("first").alias("first"), F.min(F.struct(F.col("url"))).alias("home")), "warc-owners"
    )
    repeat = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(owner, F.col("of") == F.col("digest"), "left").withColumn("repeat", repeat)
    me = _urn(F.lit("response"), F.col("page_id"), F.col("url"), F.col("digest"))
    home = _urn(F.lit("response"), F.col("first"), F.col("home.url"), F.col("digest"))
    common = [_field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("url"))]
    beside = [*common, _field("WARC-Concurrent-To", me)]
    target = F.regexp_replace(F.coalesce("url", F.lit("/")), r"[\x00-\x20]+", "%20")
    host = F.regexp_extract(target, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(END))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    request = _record(F.lit("request"), _urn(F.lit("request"), me), beside, "application/http;msgtype=request", ask)
    pointer = [
        F.when(F.col("repeat"), _field("WARC-Profile", F.lit(IDENTICAL))),
        F.when(F.col("repeat"), _field("WARC-Refers-To", home)),
    ]
    response = _record(
        F.when(F.col("repeat"), F.lit("revisit")).otherwise(F.lit("response")),
        me,
        [*common, digest, *pointer],
        "application/http;msgtype=response",
        F.concat(http, F.when(F.col("repeat"), F.lit("")).otherwise(F.col("payload"))),
    )
    about = F.concat_ws("", F.lit("software: heirloom"), _field("page-id", F.col("page_id").cast("string")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _urn(F.lit("metadata"), me), beside, "application/warc-fields", about)
    most = max(1, ARCHIVE_BYTES // (seen.get["longest"] + 4096))
    transaction = F.concat(request, F.lit(END), response, F.lit(END), metadata)
    sized = joined.select(transaction).write.option("maxRecordsPerFile", most)
    sized.text(path, compression="gzip", lineSep=END)


def _inflated(content: bytes) -> Iterator[bytes]:
    """An archive's bytes in chunks, unpacked if it is compressed, in one or many members."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), CHUNK):
            yield content[at : at + CHUNK]
        return
    while content:
        member = zlib.decompressobj(31)
        while not member.eof:
            out = member.decompress(content, CHUNK)
            content = member.unconsumed_tail
            if not out and not content:
                break
            yield out
        content = member.unused_data.lstrip(b"\x00")


def parse_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    buffer, chunks = bytearray(), iter(chunks)

    def more() -> bool:
        chunk = next(chunks, None)
        buffer.extend(chunk or b"")
        return chunk is not None

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("an archive ends inside a record")
                return
            while buffer[:2] == b"\r\n":
                del buffer[:2]
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        while len(buffer) < end + 4 + size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


def _facts(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = head.get("warc-type")
    http = fields = size = digest = payload = None
    if kind in ("response", "revisit", "request"):
        front, _, body = block.partition(b"\r\n\r\n")
        http = front.decode("utf-8", "replace")
        if kind == "response":
            size, digest = len(body), hashlib.sha256(body).hexdigest()
            payload = body if with_payload else None
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    stored = head.get("warc-payload-digest")
    names = ("warc-target-uri", "warc-date", "warc-concurrent-to", "warc-refers-to")
    return (head.get("warc-record-id"), kind, *[head.get(n) for n in names], stored, http, fields, size, digest, payload)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, its payload hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        schema = pa.schema(list(zip(names, kinds)))

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse_records(_inflated(content.as_py())):
                    rows.append(_facts(head, block, with_payload))
                    held += len(block) if with_payload else 500
                    if held > 4 * CHUNK:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, FACTS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, page_id, request, response, metadata, copies."""

    def of(kind: Column, *names: str) -> Column:
        return F.any_value(F.when(kind, F.struct(*names)), F.lit(True))

    answer = F.col("type").isin("response", "revisit")
    key = F.when(answer, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    grouped = records.filter(F.col("type").isin("request", "response", "revisit", "metadata")).groupBy(key.alias("capture_id"))
    nested = grouped.agg(
        of(F.col("type") == "request", "record_id", "target_uri", "date", "http").alias("request"),
        of(answer, "record_id", "type", "target_uri", "date", "refers_to", "digest", "http", "payload_bytes", "payload_sha256", "payload").alias("response"),
        of(F.col("type") == "metadata", "record_id", "date", "fields").alias("metadata"),
        F.count_if(answer).alias("copies"),
    )
    page = F.regexp_extract(F.coalesce("metadata.fields", F.lit("")), r"(?m)^page-id: (-?\d+)\r?$", 1)
    return nested.withColumn("page_id", F.when(page != "", page.cast("long")))


def resolved(table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture.

    Every capture meets the response that holds its payload, its own or the one that a
    revisit refers to. ``table`` is a written table of captures.
    """
    holder = table.filter("response.type = 'response'").select(
        F.col("capture_id").alias("holder"),
        F.col("page_id").alias("holder_page"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_sha256").alias("payload_digest"),
    )
    own = table.select(
        "page_id",
        F.coalesce("response.refers_to", "capture_id").alias("held_by"),
        F.col("response.type").alias("record_type"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    )
    refers = F.when(F.col("record_type") == "revisit", F.col("holder_page"))
    return own.join(holder, F.col("held_by") == F.col("holder"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to")
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives to the shared folder, read them back and resolve revisits."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return resolved(materialize(captures(read_records(spark, path, with_payload=False)), "warc-captures"))
