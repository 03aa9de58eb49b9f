"""Audit of what image and PDF files carry beside their content: EXIF, XMP, IPTC, comments, document information, claims of origin.

A file's structure is walked (JPEG segments, PNG and RIFF chunks, TIFF directories, PDF cross-references and object streams);
each finding is told with its byte range and nothing is changed. Claim stores (JUMBF superboxes) are opened too: a row for each
content box, with CBOR and JSON as JSON text. Pixels and page content are never decoded.

Files are rows (`sources.files.read_bytes`), walked one at a time in Arrow batches; nothing is shuffled. Defined results: null content
has the format null and nothing found; other formats are told as `other`, with nothing found; a broken file keeps what was found before the
break, with the reason in `error`; a PDF whose cross-references are broken is scanned for objects instead; extra columns stay.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import pdf

def _fields(names: str, whole: tuple[str, ...] = ("start", "end")) -> ArrayType:
    return ArrayType(StructType([StructField(c, LongType() if c in whole else StringType()) for c in names.split()]))


FOUND = _fields("kind start end name value")
CLAIMS = _fields("manifest label content start end value")
INSPECTED = StructType([StructField("format", StringType()), StructField("found", FOUND), StructField("claims", CLAIMS), StructField("error", StringType())])

# Names and numbers as the formats write them.
EXIF, XMP, XMP_MORE, PHOTOSHOP = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0", b"Photoshop 3.0\0"
PNG = b"\x89PNG\r\n\x1a\n"
TAGS = {
    270: "ImageDescription", 271: "Make", 272: "Model", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 33432: "Copyright",
    36867: "DateTimeOriginal", 37500: "MakerNote", 37510: "UserComment", 42032: "CameraOwnerName", 42033: "BodySerialNumber",
}
BLOCK_TAGS = {700: "xmp", 33723: "iptc", 34377: "photoshop", 52545: "jumbf"}
DIRECTORIES = {34665: "Exif", 34853: "GPS", 40965: "Interoperability"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TOOL = re.compile(rb"""(?:CreatorTool|[dD]igitalSourceType)\s*(?:=\s*["']|>)([^"'<]*)""")
AFTER_SCAN = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def _text(b: bytes) -> str:
    return b.rstrip(b"\0").decode("utf-8", "replace")


def _tool(packet: bytes) -> str:
    m = TOOL.search(packet)
    return _text(m[1]) if m else ""


class Walk:
    """What is found in one file. A store's pieces are where its bytes stand in the file, in order."""

    def __init__(self, data: bytes):
        self.data, self.found, self.claims = data, [], []

    def add(self, kind: str, start: int, end: int, name: str = "", value: str = "") -> None:
        self.found.append((kind, start, end, name, value))

    def xmp(self, start: int, end: int, name: str = "") -> None:
        self.add("xmp", start, end, name, _tool(self.data[start:end]))

    def store(self, pieces: list[tuple[int, int]], kind: str = "jumbf") -> None:
        for start, end in pieces:
            self.add(kind, start, end)
        self.open_store(b"".join(self.data[a:b] for a, b in pieces), pieces)

    def open_store(self, joined: bytes, pieces: list[tuple[int, int]]) -> None:
        """Rows of a store's content boxes. joined may be unpacked bytes: then the one piece stands for all of them."""
        whole = sum(b - a for a, b in pieces) == len(joined)

        def place(i: int) -> int:
            for a, b in pieces:
                if i < b - a:
                    return a + i
                i -= b - a
            raise ValueError("a box leaves its store")

        for manifest, label, content, a, b, value in contents(joined, 0, len(joined), ()):
            start, end = (place(a), place(b - 1) + 1 if b > a else place(a)) if whole else pieces[0]
            self.claims.append((manifest, label, content, start, end, value))

    # Images.

    def jpeg(self) -> None:
        data, at, stores = self.data, 2, {}
        while True:
            if data[at : at + 1] != b"\xff":
                raise ValueError(f"no marker at byte {at}")
            while data[at : at + 1] == b"\xff":
                at += 1
            marker, at = data[at] if at < len(data) else 0xD9, at + 1
            if at > len(data):
                raise ValueError("the file ends inside a marker")
            if marker == 0xD9:
                break
            if marker == 1 or 0xD0 <= marker <= 0xD8:
                continue
            size = int.from_bytes(data[at : at + 2])
            start, end = at + 2, at + size
            if size < 2 or end > len(data):
                raise ValueError(f"a segment at byte {at - 2} leaves the file")
            self.segment(marker, start, end, stores)
            at = end
            if marker == 0xDA:
                if not (m := AFTER_SCAN.search(data, at)):
                    raise ValueError("the image data have no end")
                at = m.start()
        for _, parts in sorted(stores.items()):
            # Later parts repeat the header of the box, so that they can be read alone.
            parts.sort()
            first = parts[0][1]
            head = 16 if data[first : first + 4] == b"\0\0\0\1" else 8
            self.store([(a if i == 0 else min(a + head, b), b) for i, (_, a, b) in enumerate(parts)])
        if at < len(data):
            self.add("trailing", at, len(data))

    def segment(self, marker: int, start: int, end: int, stores: dict) -> None:
        head = self.data[start : min(end, start + 40)]
        if marker == 0xFE:
            self.add("comment", start, end)
        elif marker == 0xE1 and head.startswith(EXIF):
            self.exif(start + len(EXIF), end)
        elif marker == 0xE1 and head.startswith(XMP):
            self.xmp(start + len(XMP), end)
        elif marker == 0xE1 and head.startswith(XMP_MORE):
            self.xmp(start + len(XMP_MORE) + 40, end, "extension")
        elif marker == 0xED and head.startswith(PHOTOSHOP):
            self.resources(start + len(PHOTOSHOP), end)
        elif marker == 0xEB and head.startswith(b"JP") and len(head) >= 16:
            stores.setdefault(head[2:4], []).append((int.from_bytes(head[4:8]), start + 8, end))

    def resources(self, at: int, end: int) -> None:
        """Photoshop's resources; number 0x0404 is the IPTC record."""
        while at + 12 <= end and self.data[at : at + 4] == b"8BIM":
            number = int.from_bytes(self.data[at + 4 : at + 6])
            name = 1 + self.data[at + 6]
            at += 6 + name + name % 2
            size = int.from_bytes(self.data[at : at + 4])
            if at + 4 + size > end:
                raise ValueError("a resource leaves its segment")
            if number == 0x0404:
                self.add("iptc", at + 4, at + 4 + size)
            at += 4 + size + size % 2

    def png(self) -> None:
        data, at, kind = self.data, len(PNG), b""
        while kind != b"IEND":
            if at + 12 > len(data):
                raise ValueError("the file ends before IEND")
            size, kind = struct.unpack_from(">I4s", data, at)
            start, end = at + 8, at + 8 + size
            if end + 4 > len(data):
                raise ValueError(f"a chunk at byte {at} leaves the file")
            if kind in (b"tEXt", b"zTXt", b"iTXt"):
                word, _, rest = data[start:end].partition(b"\0")
                if kind == b"iTXt" and word == b"XML:com.adobe.xmp":
                    # Flag and method of compression, language and translated keyword stand before the packet.
                    body = end - len(rest[2:].split(b"\0", 2)[-1])
                    self.xmp(body, end, "compressed" if rest[:1] == b"\1" else "")
                else:
                    self.add("text", start + len(word) + 1, end, word.decode("latin-1"))
            elif kind == b"eXIf":
                self.exif(start, end)
            elif kind == b"caBX":
                self.store([(start, end)])
            elif kind == b"tIME":
                self.add("time", start, end)
            at = end + 4
        if at < len(data):
            self.add("trailing", at, len(data))

    def webp(self) -> None:
        data, at = self.data, 12
        stop = min(len(data), 8 + int.from_bytes(data[4:8], "little"))
        while at + 8 <= stop:
            kind, size = struct.unpack_from("<4sI", data, at)
            start, end = at + 8, at + 8 + size
            if end > len(data):
                raise ValueError(f"a chunk at byte {at} leaves the file")
            if kind == b"EXIF":
                self.exif(start + 6 * (data[start : start + 6] == EXIF), end)
            elif kind == b"XMP ":
                self.xmp(start, end)
            elif kind == b"C2PA":
                self.store([(start, end)])
            at = end + size % 2
        if 8 + int.from_bytes(data[4:8], "little") > len(data):
            raise ValueError("the file is shorter than it says")
        if stop < len(data):
            self.add("trailing", stop, len(data))

    def exif(self, start: int, end: int) -> None:
        self.add("exif", start, end)
        self.tiff(start, end)

    def tiff(self, base: int, stop: int) -> None:
        """Directories of a TIFF structure, each once: of the file, or of an EXIF block in it."""
        data = self.data
        order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
        version = struct.unpack_from(f"{order}H", data, base + 2)[0] if order and base + 8 <= stop else 0
        if version not in (42, 43):
            raise ValueError("no TIFF header")
        big = version == 43
        count, entry, link, inline = ("Q", "HHQ", "Q", 8) if big else ("H", "HHI", "I", 4)

        def read(form: str, at: int):
            if not base <= at <= stop - struct.calcsize("=" + form):
                raise ValueError("a directory leaves its block")
            return struct.unpack_from(order + form, data, at)

        wide, head = struct.calcsize("=" + count), struct.calcsize("=" + entry)
        queue, seen = [(base + read(link, base + (8 if big else 4))[0], "")], set()
        while queue:
            at, directory = queue.pop()
            if at in seen or at == base:  # 0 ends a chain
                continue
            seen.add(at)
            (n,) = read(count, at)
            at += wide
            for place in range(at, at + n * (head + inline), head + inline):
                tag, form, items = read(entry, place)
                size = TYPE_BYTES.get(form, 1) * items
                start = place + head if size <= inline else base + read(link, place + head)[0]
                if not base <= start <= stop - size:
                    raise ValueError(f"tag {tag} leaves its block")
                if tag in DIRECTORIES:
                    queue.append((base + read(link if form in (13, 18, 16) or not big else "I", start)[0], DIRECTORIES[tag]))
                elif BLOCK_TAGS.get(tag) == "xmp":
                    self.xmp(start, start + size)
                elif BLOCK_TAGS.get(tag) == "jumbf":
                    self.store([(start, start + size)])
                elif tag in BLOCK_TAGS:
                    self.add(BLOCK_TAGS[tag], start, start + size)
                elif tag in TAGS or directory == "GPS":
                    self.add("tag", start, start + size, TAGS.get(tag) or f"GPS {tag}", _text(data[start : start + size]) if form == 2 else "")
            queue.append((base + read(link, at + n * (head + inline))[0], directory))

    # Documents.

    def pdf(self) -> str | None:
        file = pdf.File(self.data)
        for key, value, start, end in file.information():
            self.add("info", start, end, key, value)
        for start, end, packet in file.metadata():
            self.add("xmp", start, end, "", _tool(packet))
        for start, end, store in file.stores():
            self.add("jumbf", start, end)
            self.open_store(store, [(start, end)])
        return file.error


# Claim stores.

MOST_DEPTH = 32


def contents(data: bytes, start: int, end: int, labels: tuple[str, ...]) -> Iterator[tuple]:
    """manifest, label, content, start, end, value of the content boxes in the superboxes between start and end."""
    if len(labels) > MOST_DEPTH:
        raise ValueError("superboxes are nested too deeply")
    inside = labels
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and end - body >= 8:
            size, body = int.from_bytes(data[body : body + 8]), body + 8
        stop = end if size == 0 else start + size
        if not body <= stop <= end:
            raise ValueError(f"box {kind!r} leaves its container")
        if kind == b"jumb":
            yield from contents(data, body, stop, labels)
        elif kind == b"jumd":
            flags = data[body + 16 : body + 17]
            label = data[body + 17 : stop].split(b"\0", 1)[0] if flags and flags[0] & 2 else b""
            inside = labels = (*inside, _text(label))
        elif kind not in (b"free", b"c2sh"):
            manifest = labels[1] if len(labels) > 1 else ""
            yield manifest, labels[-1] if labels else "", kind.decode("latin-1").strip(), body, stop, _value(kind, data[body:stop])
        start = stop


def _value(kind: bytes, body: bytes) -> str:
    """JSON of a CBOR or JSON box; empty for others and for what can't be read."""
    try:
        if kind == b"cbor":
            return json.dumps(cbor(body, 0, 0)[0], ensure_ascii=False)
        return json.dumps(json.loads(body), ensure_ascii=False) if kind == b"json" else ""
    except (ValueError, RecursionError):
        return ""


def cbor(b: bytes, at: int, depth: int) -> tuple[object, int]:
    """One item of CBOR and where the next begins. Byte strings are told in hex, tags are dropped, keys become text."""
    if at >= len(b) or depth > MOST_DEPTH:
        raise ValueError("CBOR is cut off or too deep")
    major, low, at = b[at] >> 5, b[at] & 31, at + 1
    endless = low == 31
    if 28 <= low <= 30 or endless and major in (0, 1, 6):
        raise ValueError("not CBOR")
    wide = 1 << low - 24 if 24 <= low <= 27 else 0
    n, raw = (int.from_bytes(b[at : at + wide]), b[at : at + wide]) if wide else (low, b"")
    at += wide
    if at > len(b):
        raise ValueError("CBOR is cut off")
    if major < 2:
        return (n if major == 0 else -1 - n), at
    if major == 6:
        return cbor(b, at, depth + 1)
    if major == 7:
        if wide > 1:
            x = struct.unpack({2: ">e", 4: ">f", 8: ">d"}[wide], raw)[0]
            return (x if x - x == 0 else str(x)), at
        return {20: False, 21: True}.get(n), at
    if major in (2, 3) and not endless:
        if at + n > len(b):
            raise ValueError("CBOR is cut off")
        part = b[at : at + n]
        return (part.hex() if major == 2 else part.decode("utf-8")), at + n
    out = []
    while not (b[at : at + 1] == b"\xff" if endless else len(out) == n * (1 + (major == 5))):
        item, at = cbor(b, at, depth + 1)
        out.append(item)
    at += endless
    if major in (2, 3):
        return "".join(map(str, out)), at
    if major == 4:
        return out, at
    if len(out) % 2:
        raise ValueError("a key without a value")
    return {k if isinstance(k, str) else json.dumps(k): v for k, v in zip(out[::2], out[1::2], strict=True)}, at


def format_of(data: bytes) -> str:
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == PNG:
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return "tiff"
    return "pdf" if b"%PDF-" in data[:1024] else "other"


def inspect(data: bytes | None) -> tuple:
    """format, found, claims, error of one file."""
    if data is None:
        return None, [], [], None
    walk, kind, error = Walk(data), format_of(data), None
    try:
        if kind == "tiff":
            walk.tiff(0, len(data))
        elif kind != "other":
            error = getattr(walk, kind)()
    except (*pdf.BROKEN, struct.error) as e:
        error = str(e) or type(e).__name__
    return kind, walk.found, walk.claims, error


@F.pandas_udf(INSPECTED)
def inspected(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for c in contents:
        kind, found, claims, error = inspect(None if c is None else bytes(c))
        named = [[dict(zip(t.elementType.names, x, strict=True)) for x in xs] for t, xs in ((FOUND, found), (CLAIMS, claims))]
        rows.append((kind, *named, error))
    return pd.DataFrame(rows, columns=INSPECTED.names)


def audit(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `embedded`: format, found (ranges), claims (content boxes of claim stores), error. One row a file."""
    return files.withColumn("embedded", inspected(content))


def findings(audited: DataFrame, *keep: str) -> DataFrame:
    """keep, format, kind, start, end, name, value: a row for each finding."""
    rows = audited.select(*keep, F.col("embedded.format").alias("format"), F.explode("embedded.found").alias("__f"))
    return rows.select(*keep, "format", "__f.*")


def assertions(audited: DataFrame, *keep: str) -> DataFrame:
    """keep, format, manifest, label, content, start, end, value: a row for each content box of the claim stores."""
    rows = audited.select(*keep, F.col("embedded.format").alias("format"), F.explode("embedded.claims").alias("__c"))
    return rows.select(*keep, "format", "__c.*")
