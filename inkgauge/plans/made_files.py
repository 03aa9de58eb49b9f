"""Image and PDF files that Spark makes of the documents' texts, for the queries over what files carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bytes of a JPEG comment, at most.
COMMENT_BYTES = 60_000
OPENING = "<x:xmpmeta>"


def raw(b: bytes) -> Column:
    return F.unhex(F.lit(b.hex()))


def big(n: Column, width: int = 4) -> Column:
    """A whole number in bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), width * 2, "0"))


def little(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def size(b: Column) -> Column:
    return F.octet_length(b).cast("long")


def png_chunk(kind: bytes, body: Column) -> Column:
    told = F.concat(raw(kind), body)
    return F.concat(big(size(body)), told, big(F.crc32(told)))


def png(*chunks: Column) -> Column:
    head = png_chunk(b"IHDR", raw(b"\0\0\0\1\0\0\0\1\x08\0\0\0\0"))
    return F.concat(raw(b"\x89PNG\r\n\x1a\n"), head, *chunks, png_chunk(b"IEND", raw(b"")))


def png_of(packet: Column) -> Column:
    return png(png_chunk(b"tEXt", raw(b"Software\0inkgauge")), png_chunk(b"iTXt", F.concat(raw(b"XML:com.adobe.xmp\0\0\0\0\0"), packet)))


def jpeg_of(packet: Column) -> Column:
    """EXIF with the software's name, and the packet in comments of 60,000 bytes."""
    directory = b"II*\0\x08\0\0\0\1\0" + b"\x31\1\2\0\x09\0\0\0\x1a\0\0\0" + bytes(4) + b"inkgauge\0"
    exif = b"Exif\0\0" + directory
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(size(packet) / COMMENT_BYTES)).cast("int") - 1)

    def segment(i: Column) -> Column:
        part = F.substring(packet, i * COMMENT_BYTES + 1, COMMENT_BYTES)
        return F.hex(F.concat(raw(b"\xff\xfe"), big(size(part) + 2, 2), part))

    comments = F.unhex(F.array_join(F.transform(pieces, segment), ""))
    scan = b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\xab\xff\0\xcd\xff\xd0\xef"
    return F.concat(raw(b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2) + exif), comments, raw(scan + b"\xff\xd9"))


def webp_of(packet: Column) -> Column:
    odd = F.when(size(packet) % 2 == 1, raw(b"\0")).otherwise(raw(b""))
    body = F.concat(raw(b"WEBPXMP "), little(size(packet)), packet, odd)
    return F.concat(raw(b"RIFF"), little(size(body)), body)


def tiff_of(packet: Column) -> Column:
    head = b"II*\0\x08\0\0\0\2\0" + b"\x31\1\2\0\x09\0\0\0\x26\0\0\0" + b"\xbc\2\1\0"
    return F.concat(raw(head), little(size(packet)), raw(b"\x2f\0\0\0" + bytes(4) + b"inkgauge\0"), packet)


def packet(text: Column) -> Column:
    return F.encode(F.concat(F.lit(OPENING), F.coalesce(text, F.lit(""))), "utf-8")


def image_of(kind: Column, packet: Column) -> Column:
    """kind: 0 PNG, 1 JPEG, 2 WebP, 3 TIFF."""
    return F.when(kind == 0, png_of(packet)).when(kind == 1, jpeg_of(packet)).when(kind == 2, webp_of(packet)).otherwise(tiff_of(packet))


def superbox(label: Column, *inside: Column) -> Column:
    told = F.concat(raw(bytes(16) + b"\3"), label, raw(b"\0"))
    return box(b"jumb", F.concat(box(b"jumd", told), *inside))


def box(kind: bytes, body: Column) -> Column:
    return F.concat(big(size(body) + 8), raw(kind), body)


def claim_store(doc_id: Column, text: Column) -> Column:
    """A store of one manifest, named after the document: an assertion in CBOR with its text, one in JSON with its id, and the claim."""
    name, body = F.encode(F.concat(F.lit("urn:"), doc_id.cast("string")), "utf-8"), F.encode(F.coalesce(text, F.lit("")), "utf-8")
    label = lambda s: raw(s.encode())
    said = superbox(label("c2pa.actions"), box(b"cbor", F.concat(raw(b"\xa1\x64text\x7a"), big(size(body)), body)))
    work = superbox(label("stds.schema-org.CreativeWork"), box(b"json", F.encode(F.concat(F.lit('{"text":"'), doc_id.cast("string"), F.lit('"}')), "utf-8")))
    claim = superbox(label("c2pa.claim"), box(b"cbor", raw(b"\xa1\x64text\x68inkgauge")))
    return superbox(label("c2pa"), superbox(name, superbox(label("c2pa.assertions"), said, work), claim))


def pdf_of(doc_id: Column, packet: Column) -> Column:
    """A catalog, document information, and the packet as a metadata stream, with a table of cross-references."""
    number = doc_id.cast("string")
    plain = lambda *parts: F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "utf-8")
    objects = [
        plain("1 0 obj\n<< /Type /Catalog /Metadata 3 0 R >>\nendobj\n"),
        plain("2 0 obj\n<< /Producer (inkgauge \\(", number, "\\)) /Title <", F.hex(F.encode(number, "utf-8")), "> >>\nendobj\n"),
        F.concat(plain("3 0 obj\n<< /Type /Metadata /Subtype /XML /Length ", size(packet).cast("string"), " >>\nstream\n"), packet, plain("\nendstream\nendobj\n")),
    ]
    places, at = [], F.lit(9).cast("long")
    for o in objects:
        places.append(F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n")))
        at = at + size(o)
    table = plain("xref\n0 4\n0000000000 65535 f \n", *places, "trailer\n<< /Size 4 /Root 1 0 R /Info 2 0 R >>\nstartxref\n", at.cast("string"), "\n%%EOF\n")
    return F.concat(plain("%PDF-1.7\n"), *objects, table)
