"""WARC archives: written through Spark's file writer, read back record by record, assembled to captures.

Writing. Each page becomes three records: request, response (or revisit) and metadata. The last is where the
page's id is kept; request and metadata name the response by WARC-Concurrent-To. The text writer puts records out
as they are, with the CRLF that ends a record as its line end, so files come into being by Spark's commit protocol
in any store Spark can write. Every record begins with a boundary line (the version and a field with a nonce);
the text reader takes this boundary as its line end, so archives are read in splits, and what must fit in memory
is one record, never an archive. Archives of other writers, which hold no such field, and gzip ones are read by
read_archives(), which cuts records by their length.

Record ids are hashes of what a record is of, so a task that runs twice writes the same ones. Revisits. Of pages with equal payloads (SHA-256) of `min_bytes` at least the one with the smallest id is the
response. Payloads that occur once need no entry, so what meets the pages again is one narrow row for each
repeated payload.

Assembly. Requests and metadata find their response through the concurrent-to identifiers on either side, and a
capture is one nested row. A revisit's payload is its response's, found by WARC-Refers-To.

Defined results: null html is an empty payload; a null id comes after all others and is read back as null; of rows
alike in id and payload that with the smallest url (null last) is the response, of rows alike in all one; a null url leaves out WARC-Target-URI; an empty table gives an archive
without records; extra columns are not archived.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import join_small, scratch_path, text_of, written

CRLF = "\r\n"
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits (a SHA-1), by five digits at a time."""
    letters = []
    for g in range(8):
        v = F.conv(F.substring(digest, g * 5 + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*letters)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def boundary(nonce: str) -> str:
    return f"WARC/1.1{CRLF}WARC-Boundary: {nonce}{CRLF}"


def _record(nonce: str, kind: str | Column, record_id: Column, fields: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """A record without its last CRLF. A field that is null is left out."""
    lines = [F.lit(boundary(nonce)), F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}")]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields]
    return F.concat(*lines, F.lit(f"Content-Type: {content}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF))


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    date: str = "2026-01-01T00:00:00Z",
) -> str:
    """Writes the archives under path and returns the nonce of their boundary, by which read_records() splits them."""
    nonce = uuid.uuid4().hex[:16]
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"),
    ).withColumn("payload_key", F.unhex(F.sha2("html", 256)))
    alike = ["payload_key", "page_id", "url"]
    per = written(base.withColumn("long", F.octet_length("html") >= min_bytes).groupBy(*alike, "long").agg(F.count("*").alias("n")), "pages")
    # Rows alike in all that is archived are told apart by a number; they meet as one row with a count.
    again = per.where("n > 1").select(*alike, "n")
    twin = join_small(base, again, alike)
    numbered = twin.where("n is null").drop("n").withColumn("no", F.lit(1)).unionByName(
        twin.where("n is not null").groupBy(*alike).agg(F.first("html").alias("html"), F.first("n").alias("n"))
        .withColumn("no", F.explode(F.expr("sequence(1, cast(n as int))"))).drop("n")
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    same = (
        per.where("long").groupBy("payload_key").agg(F.min(order).alias("f"), F.sum("n").alias("n")).where("n > 1")
        .select("payload_key", F.lit(True).alias("shared"), F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    )

    def ids(kind: str, page: Column, url: Column, no: Column) -> Column:
        return _uuid(F.lit(nonce), F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("u"), url), F.lit("-")), F.hex("payload_key"), no.cast("string"))

    page, url, no = F.col("page_id"), F.col("url"), F.col("no")
    is_first = page.eqNullSafe(F.col("first_id")) & url.eqNullSafe(F.col("first_url")) & (no == 1)
    known = (
        join_small(numbered, same, ["payload_key"])
        .withColumn("again", F.col("shared").isNotNull() & ~is_first)
        .withColumn("sha1", F.sha1("html"))
        .withColumn("rid", ids("response", page, url, no))
        .withColumn("refers", F.when(F.col("again"), F.concat(F.lit("<"), ids("response", F.col("first_id"), F.col("first_url"), F.lit(1)), F.lit(">"))))
        .withColumn("uri", F.regexp_replace("url", r"[\x00-\x1f\x7f]", ""))
    )
    stamp = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri"))]
    beside = [("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("rid"), F.lit(">"))), *stamp]
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), r"://(?:[^/?#@]*@)?([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce("uri", F.lit("")), r"://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    request = _record(nonce, "request", ids("request", page, url, no), beside, "application/http;msgtype=request", ask)
    capture = _record(
        nonce, F.when(F.col("again"), "revisit").otherwise("response"), F.col("rid"),
        [*stamp, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))), ("WARC-Refers-To", F.col("refers")),
         ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        "application/http;msgtype=response", F.when(F.col("again"), head).otherwise(F.concat(head, F.col("html"))),
    )
    note = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(nonce, "metadata", ids("metadata", page, url, no), beside, "application/warc-fields", note)
    known.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.option("lineSep", CRLF).text(path)
    return nonce


def read_records(spark: SparkSession, path: str, nonce: str) -> DataFrame:
    """record_type, record_id, target_uri, concurrent_to, refers_to, header, content_length, block (bytes)."""
    lines = spark.read.option("lineSep", boundary(nonce)).text(path).where("value != ''")
    field = lambda name: F.regexp_extract("header", rf"(?im)^{name}:[ \t]*<?([^\r\n>]*)", 1)
    none = lambda c: F.when(c != "", c)
    return (
        lines.withColumn("header", F.substring_index("value", CRLF * 2, 1))
        .withColumn("content_length", field("Content-Length").cast("long"))
        .select(
            field("WARC-Type").alias("record_type"),
            field("WARC-Record-ID").alias("record_id"),
            none(field("WARC-Target-URI")).alias("target_uri"),
            F.regexp_extract_all("header", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*<?([^\r\n>]*)"), F.lit(1)).alias("concurrent_to"),
            none(field("WARC-Refers-To")).alias("refers_to"),
            "header",
            "content_length",
            F.substr(F.col("value").cast("binary"), F.octet_length("header") + 5, F.col("content_length").cast("int")).alias("block"),
        )
    )


RECORD = "record_type string, record_id string, target_uri string, concurrent_to array<string>, refers_to string, header string, content_length long, block binary"
CHUNK = 1 << 20


def _unzipped(data: bytes) -> Iterator[bytes]:
    """The content of an archive's bytes, in chunks; of gzip members one behind another, each."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + CHUNK] for at in range(0, len(data), CHUNK))
        return
    rest = memoryview(data)
    while len(rest):
        member, first = zlib.decompressobj(31), len(data) - len(rest)
        try:
            while not member.eof and len(rest):
                part, rest = rest[:CHUNK], rest[CHUNK:]
                yield member.decompress(part)
                if member.unused_data:
                    rest = memoryview(data)[len(data) - len(rest) - len(member.unused_data) :]
            yield member.flush()
        except zlib.error:
            # The next member begins where one can; what is no record tells the reader that something is missing.
            again = data.find(b"\x1f\x8b\x08", first + 1)
            rest = memoryview(data)[again:] if again > 0 else rest[:0]
            yield b"\r\n\x00broken gzip member\r\n"
        while len(rest) and rest[0] == 0:  # padding behind the last member
            rest = rest[1:]


#: What a record begins with, at the start of a line.
START = re.compile(rb"[\r\n]WARC/\d")


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of one archive, cut by their Content-Length.

    What is no whole record is told by one row of the type "error": where it lies and why in header, the bytes that are left out in
    content_length, no block. Reading goes on at the next line that a record can begin at, so nothing behind is lost. A record whose length
    is wrong is known by what follows it.
    """
    chunks, held, gone = _unzipped(data), bytearray(), 0

    def have(n: int) -> bool:
        while len(held) < n:
            if (more := next(chunks, None)) is None:
                return False
            held.extend(more)
        return True

    def skip(reason: str) -> tuple:
        """Drops what is held up to the next start of a record."""
        nonlocal gone
        at, seen = gone, 1
        while not (m := START.search(held, max(0, seen - 8))):
            seen = len(held)
            if not have(seen + 1):
                break
        n = m.start() + 1 if m else len(held)
        del held[:n]
        gone += n
        return "error", None, None, [], None, f"{reason}, at byte {at}", n, None

    while True:
        while have(1) and held[:1] in b"\r\n":
            del held[:1]
            gone += 1
        if not held:
            return
        if have(5) and not held.startswith(b"WARC/") or len(held) < 5:
            yield skip("no record")
            continue
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not have(seen + 1):
                break
        inner = START.search(held, 1, end if end >= 0 else len(held))
        if end < 0 or inner:
            yield skip("a header without an end")
            continue
        header = held[:end].decode("utf-8", "replace")
        fields: dict[str, list[str]] = {}
        for line in re.sub(r"\r\n[ \t]+", " ", header).split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip().removeprefix("<").removesuffix(">"))
        one = lambda name: fields.get(name, [None])[0]  # noqa: E731, B023
        size = one("content-length") or ""
        stop = end + 4 + int(size) if size.isascii() and size.isdigit() else -1
        if stop < 0 or not have(stop):
            yield skip("a record without a length" if stop < 0 else "a record cut short")
            continue
        if have(stop + 1) and held[stop] not in b"\r\nW":
            yield skip("a record of another length than it tells")
            continue
        block = bytes(held[end + 4 : stop])
        del held[:stop]
        gone += stop
        yield one("warc-type"), one("warc-record-id"), one("warc-target-uri"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), header, int(size), block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The columns of read_records() for any writer's archives, plain or gzip by record or whole.

    A file is one task's and must fit in memory as it is stored; its content is unpacked a record at a time. What isn't a whole record is a
    row of the type "error" (see parse_archive).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("header", pa.string()), ("content_length", pa.int64()), ("block", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for record in parse_archive(content.as_py()):
                    rows.append(record)
                    held += record[6]
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, RECORD)


def http_payload(block: Column) -> Column:
    """What follows the HTTP header, as bytes."""
    return F.substr(block, F.octet_length(F.substring_index(block.cast("string"), CRLF * 2, 1)) + 5)


def captures(records: DataFrame) -> DataFrame:
    """One row for each response, revisit or resource, with what was recorded beside it.

    record_id, record_type, target_uri, refers_to, payload_bytes, sha1 and payload (of the record itself; null for a
    revisit), requests and metadata (arrays of record_id, header, block).
    """
    main = F.col("record_type").isin("response", "revisit", "resource")
    side = records.where(F.col("record_type").isin("request", "metadata"))
    by_side = side.select(F.explode("concurrent_to").alias("capture"), "record_id")
    by_main = records.where(main).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id"))
    links = by_side.union(by_main).distinct()
    part = F.struct("record_id", "header", "block")
    beside = (
        links.join(side.select("record_id", "record_type", "header", "block"), "record_id")
        .groupBy("capture")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("record_type") == "request", part))).alias("requests"),
            F.sort_array(F.collect_list(F.when(F.col("record_type") == "metadata", part))).alias("metadata"),
        )
    )
    payload = F.when(F.col("record_type") == "resource", F.col("block")).when(F.col("record_type") == "response", http_payload(F.col("block")))
    return (
        records.where(main)
        .withColumn("payload", payload)
        .select(
            F.col("record_id").alias("capture"), "record_type", "target_uri", "refers_to", "payload",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"),
        )
        .join(beside, "capture", "left")
        .withColumnRenamed("capture", "record_id")
    )


def page_rows(found: DataFrame) -> DataFrame:
    """A row for each capture of write_warc(), with the payload's size and digest; revisits get their response's."""
    note = F.get(F.col("metadata.block"), F.lit(0)).cast("string")
    page = F.regexp_extract(note, r"(?m)^page-id:[ \t]*(-?\d+)", 1)
    rows = found.select(
        "record_id", "record_type", "refers_to", F.when(page != "", page.cast("long")).alias("page_id"), "payload_bytes",
        base32_of_hex(F.col("sha1")).alias("payload_digest"),
    )
    referred = rows.where("record_type = 'revisit'").select("refers_to").distinct()
    origin = rows.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")
    )
    return join_small(rows, referred.join(origin, "refers_to"), ["refers_to"]).select(
        "page_id",
        F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "o_digest").alias("payload_digest"),
        "record_type",
        F.col("o_id").alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    nonce = write_warc(pages, path, **columns)
    # Page rows need no headers, so these aren't moved.
    records = read_records(pages.sparkSession, path, nonce).withColumn("header", F.lit(None).cast("string"))
    return page_rows(captures(records))
