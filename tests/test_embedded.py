"""What image and PDF files carry, over files built here byte by byte."""

import json
import struct
import zlib

import pytest

from inkgauge.operators import embedded as E
from inkgauge.operators import pdf


def kinds(data):
    return [f[0] for f in E.inspect(data)[1]]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def superbox(label, *inside):
    return box(b"jumb", box(b"jumd", bytes(16), b"\3", label, b"\0"), *inside)


STORE = superbox(
    b"c2pa",
    superbox(b"urn:1", superbox(b"c2pa.assertions", superbox(b"c2pa.actions", box(b"cbor", b"\xa1\x67actions\x81\xa1\x66action\x6cc2pa.created"))), superbox(b"c2pa.claim", box(b"cbor", b"\xa1\x61a\x01"))),
    superbox(b"urn:2", superbox(b"c2pa.assertions", superbox(b"x.json", box(b"json", b'{"k": [1, null]}'), box(b"free", b"...")), superbox(b"x.file", box(b"bidb", b"\1\2")))),
)
CLAIMS = [
    ("urn:1", "c2pa.actions", "cbor", {"actions": [{"action": "c2pa.created"}]}), ("urn:1", "c2pa.claim", "cbor", {"a": 1}),
    ("urn:2", "x.json", "json", {"k": [1, None]}), ("urn:2", "x.file", "bidb", None),
]


def told(claims):
    return [(m, label, c, json.loads(v) if v else None) for m, label, c, _, _, v in claims]


def exif(order=">"):
    """A directory with Software and a link to GPS with its own tag."""
    e = lambda tag, form, n, v: struct.pack(order + "HHI4s", tag, form, n, v)
    n4 = lambda v: struct.pack(order + "I", v)
    first = struct.pack(order + "H", 2) + e(305, 2, 6, n4(60)) + e(34853, 4, 1, n4(38)) + n4(0)
    gps = struct.pack(order + "H", 1) + e(1, 2, 2, b"N\0\0\0") + n4(8)  # the chain goes back to the first directory
    return {">": b"MM\0*", "<": b"II*\0"}[order] + n4(8) + first + gps + bytes(60 - 8 - len(first) - len(gps)) + b"maker\0"


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments, tail=b""):
    scan = segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\x00\xff\xd3\x34\xff\xff"
    return b"\xff\xd8" + b"".join(segments) + scan[:-1] + b"\xff\xd9" + tail


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks):
    return E.PNG + chunk(b"IHDR", bytes(13)) + b"".join(chunks) + chunk(b"IEND", b"")


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


PACKET = b"<?xpacket begin=''?><x xmp:CreatorTool=\"a tool\"/><?xpacket end='w'?>"


def test_jpeg_segments_and_a_store_in_parts():
    parts = [segment(0xEB, b"JP\0\1" + struct.pack(">I", i + 1) + (STORE[:8] if i else b"") + STORE[a:b]) for i, (a, b) in enumerate([(0, 90), (90, 200), (200, len(STORE))])]
    iptc = b"8BIM\x04\x04\0\0" + struct.pack(">I", 5) + b"iptc!\0"
    data = jpeg(segment(0xE1, E.EXIF + exif()), segment(0xE1, E.XMP + PACKET), segment(0xED, E.PHOTOSHOP + iptc), parts[2], parts[0], segment(0xFE, b"hello"), parts[1], tail=b"more")
    kind, found, claims, error = E.inspect(data)
    assert (kind, error) == ("jpeg", None)
    assert [f[0] for f in found] == ["exif", "tag", "tag", "xmp", "iptc", "comment", "jumbf", "jumbf", "jumbf", "trailing"]
    at = {f[0]: data[f[1] : f[2]] for f in found}
    assert (at["xmp"], at["iptc"], at["comment"], at["trailing"]) == (PACKET, b"iptc!", b"hello", b"more")
    assert [f[3:] for f in found[1:4]] == [("Software", "maker"), ("GPS 1", "N"), ("", "a tool")]
    assert b"".join(data[f[1] : f[2]] for f in found if f[0] == "jumbf") == STORE
    assert told(claims) == CLAIMS
    assert data[claims[-1][3] : claims[-1][4]] == b"\1\2"


@pytest.mark.parametrize("order", "<>")
def test_png_webp_and_tiff(order):
    text = chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0en\0key\0" + PACKET)
    packed = chunk(b"iTXt", b"XML:com.adobe.xmp\0\1\0\0\0" + zlib.compress(PACKET))
    data = png(chunk(b"tEXt", b"Title\0a"), text, packed, chunk(b"eXIf", exif(order)), chunk(b"caBX", STORE), chunk(b"tIME", bytes(7)))
    kind, found, claims, error = E.inspect(data)
    assert (kind, error, told(claims)) == ("png", None, CLAIMS)
    assert [f[0] for f in found] == ["text", "xmp", "xmp", "exif", "tag", "tag", "jumbf", "time"]
    assert data[found[0][1] : found[0][2]] == b"a" and data[found[1][1] : found[1][2]] == PACKET and zlib.decompress(data[found[2][1] : found[2][2]]) == PACKET
    data = webp((b"EXIF", exif(order)), (b"XMP ", PACKET), (b"C2PA", STORE), (b"VP8 ", b"pixel"))
    kind, found, claims, error = E.inspect(data + b"x")
    assert (kind, error, told(claims)) == ("webp", None, CLAIMS)
    assert [f[0] for f in found] == ["exif", "tag", "tag", "xmp", "jumbf", "trailing"]
    assert E.inspect(exif(order))[::3] == ("tiff", None) and kinds(exif(order)) == ["tag", "tag"]


def test_broken_files_keep_what_was_found():
    whole = png(chunk(b"tEXt", b"Title\0a"), chunk(b"eXIf", exif()), chunk(b"caBX", STORE))
    pictures = [whole, jpeg(segment(0xE1, E.EXIF + exif()), segment(0xFE, b"c")), webp((b"EXIF", exif()), (b"C2PA", STORE)), exif(), document(), document(streams=True)]
    for data in pictures:
        assert E.inspect(data)[3] is None
        for cut in range(12, len(data) - 1):
            kind, found, _, error = E.inspect(data[:cut])
            assert kind != "other" and all(0 <= f[1] <= f[2] <= cut for f in found)
            assert kind == "pdf" or error
        for at in range(12, len(data), 3):  # a byte changed anywhere raises nothing
            E.inspect(data[:at] + bytes([data[at] ^ 0x5A]) + data[at + 1 :])
    assert kinds(whole[:80]) == ["text"]
    assert E.inspect(None) == (None, [], [], None) and E.inspect(b"")[0] == "other" and E.inspect(b"plain")[0] == "other"


def document(streams=False, broken=False, encrypted=False, info=True):
    """Information changed by a second revision, two packets (one deflated), a claim store; or the same in object and cross-reference streams."""
    out, places = bytearray(b"%PDF-1.7\n% a comment\n"), {}

    def put(n, body):
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    def stream(d, body):
        return b"<< %s /Length %d >>\nstream\r\n%s\nendstream" % (d, len(body), body)

    old, new = b"<< /Producer (old) >>", rb"<< /Producer (a \(b\) \101(c)) /Title <FEFF00E9> /Au#74hor 8 0 R >>"
    rest = {1: b"<< /Type /Catalog /Metadata 3 0 R >>", 5: b"<< /Type /Filespec /AFRelationship /C2PA_Manifest /EF << /F 6 0 R >> >>", 8: b"(me)"}
    put(3, stream(b"/Type /Metadata", PACKET))
    put(4, stream(b"/Type /Metadata /Filter /FlateDecode", zlib.compress(PACKET)))
    put(6, stream(b"/Type /EmbeddedFile /Filter [/FlateDecode]", zlib.compress(STORE)))
    extra = b"/Encrypt 1 0 R" if encrypted else b""
    if not streams:
        for n, body in {**rest, 2: old}.items():
            put(n, body)
        at = len(out)
        out.extend(b"xref\n0 1\n0000000000 65535 f \n")
        for n in sorted(places):
            out.extend(b"%d 1\n%010d 00000 n \n" % (n, places[n]))
        out.extend(b"trailer\n<< /Size 9 /Root 1 0 R /Info 2 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (extra, at))
        put(2, new)
        second = len(out)
        out.extend(b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Info 2 0 R /Prev %d %s >>\nstartxref\n%d\n%%%%EOF" % (places[2], at, extra, 7 if broken else second))
        return bytes(out)
    rest[2], heads, bodies = new, b"", b""
    for n, body in rest.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    put(7, stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(rest), len(heads)), zlib.compress(heads + bodies)))
    at, rows = len(out), []
    places[9] = at
    for n in range(10):
        rows.append(struct.pack(">BHB", 2, 7, list(rest).index(n)) if n in rest else struct.pack(">BHB", 1, places[n], 0) if n in places else bytes(4))
    before, body = bytes(4), b""
    for r in rows:  # rows as differences from the one above
        body += b"\2" + bytes((x - y) % 256 for x, y in zip(r, before, strict=True))
        before = r
    put(9, stream(b"/Type /XRef /W [1 2 1] /Size 10 /Root 1 0 R /Info 2 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >>" + extra, zlib.compress(body)))
    out.extend(b"startxref\n%d\n%%%%EOF\n" % (7 if broken else at))
    return bytes(out)


@pytest.mark.parametrize("streams", [False, True])
@pytest.mark.parametrize("broken", [False, True])
def test_pdf(streams, broken):
    data = document(streams, broken)
    kind, found, claims, error = E.inspect(data)
    assert kind == "pdf" and bool(error) == broken
    assert [(f[3], f[4]) for f in found if f[0] == "info"] == [("Producer", "a (b) A(c)"), ("Title", "é"), ("Author", "me")]
    packets = [data[f[1] : f[2]] for f in found if f[0] == "xmp"]
    assert packets[0] == PACKET and zlib.decompress(packets[1]) == PACKET and {f[4] for f in found if f[0] == "xmp"} == {"a tool"}
    (store,) = [f for f in found if f[0] == "jumbf"]
    assert zlib.decompress(data[store[1] : store[2]]) == STORE and told(claims) == CLAIMS
    info = next(f for f in found if f[0] == "info")
    assert data[info[1] : info[2]].startswith(b"7 0 obj" if streams else b"2 0 obj") and data[info[1] : info[2]].endswith(b"endobj")


def test_encrypted_and_odd_pdf():
    kind, found, claims, error = E.inspect(document(encrypted=True))
    assert "encrypted" in error and {f[4] for f in found} == {""} and not claims
    assert E.inspect(b"%PDF-1.4\nnothing")[0] == "pdf" and E.inspect(b"%PDF-1.4\nnothing")[3]
    loop = b"%PDF-1.4\n1 0 obj 1 0 R endobj\nxref\n0 1\n0000000000 65535 f \ntrailer << /Root 1 0 R /Info 1 0 R /Prev 31 >>\nstartxref\n31\n"
    assert E.inspect(loop)[0] == "pdf"
    assert pdf.value(b"<< /A [1 -2.5 true null (x(y)\\)) <4> 3 0 R] /B << >> >>", 0)[0] == {"A": [1, -2.5, True, None, b"x(y))", b"@", 3], "B": {}}


def test_cbor():
    for b, v in [
        (b"\x00", 0), (b"\x18\x64", 100), (b"\x39\x03\xe7", -1000), (b"\xf9\x3c\x00", 1.0), (b"\xfb\x3f\xf1\x99\x99\x99\x99\x99\x9a", 1.1), (b"\xf4", False), (b"\xf6", None),
        (b"\xc1\x1a\x51\x4b\x67\xb0", 1363896240), (b"\x44\1\2\3\4", "01020304"), (b"\x7f\x65strea\x64ming\xff", "streaming"), (b"\x9f\x01\x82\x02\x03\xff", [1, [2, 3]]), (b"\xbf\x61a\x01\xff", {"a": 1}), (b"\xa1\x01\x02", {"1": 2}),
    ]:
        assert E.cbor(b, 0, 0) == (v, len(b))
    for b in (b"", b"\x1c", b"\x62a", b"\x9f\x01", b"\xbf\x01\xff", b"\x81" * 100):
        with pytest.raises(ValueError):
            E.cbor(b, 0, 0)


def test_rows(spark):
    files = spark.createDataFrame([("a", bytearray(png(chunk(b"caBX", STORE))), 1), ("b", None, 2), ("c", bytearray(b"text"), 3), ("a", bytearray(png()[:30]), 4)], "path string, content binary, kind int")
    audited = E.audit(files)
    assert [(r.path, r.kind, r.embedded.format, len(r.embedded.found), bool(r.embedded.error)) for r in audited.orderBy("kind").collect()] == [("a", 1, "png", 1, False), ("b", 2, None, 0, False), ("c", 3, "other", 0, False), ("a", 4, "png", 0, True)]
    rows = E.assertions(audited, "path").collect()
    assert [(r.manifest, r.label, r.content, json.loads(r.value) if r.value else None) for r in rows] == CLAIMS
    assert E.findings(audited, "path").count() == 1 and E.findings(E.audit(files.limit(0)), "path").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from inkgauge import cli

    (tmp_path / "below").mkdir()
    for name, data in {"a.PNG": png(chunk(b"tEXt", b"Title\0a")), "below/b.pdf": document(), "c.txt": b"text", "d.jpeg": b"\xff\xd8\xff\xe1\0", "e.webp": webp()}.items():
        (tmp_path / name).write_bytes(data)
    assert cli.main(["inspect", str(tmp_path), "--json"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    told = sorted((r["path"].rsplit("/", 1)[1], r["format"], r.get("kind", ""), "error" in r) for r in rows)
    assert told == [("a.PNG", "png", "text", False), *[("b.pdf", "pdf", k, False) for k in ("info", "info", "info", "jumbf", "xmp", "xmp")], ("d.jpeg", "jpeg", "", True), ("e.webp", "webp", "", False)]
