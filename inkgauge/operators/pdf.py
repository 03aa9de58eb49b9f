"""Where a PDF file keeps information on itself: cross-references, object streams, /Info, metadata streams, claim stores.

Only dictionaries are read; content streams are neither unpacked nor looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

#: What a packed stream may unpack to.
MOST_UNPACKED = 64 * 1024 * 1024
MOST_DEPTH = 64
#: What reading a broken file may raise, whatever its bytes are.
BROKEN = (ValueError, IndexError, KeyError, TypeError, AttributeError, OverflowError, RecursionError, zlib.error)
SPACE = rb"(?:[\0\t\n\f\r ]|%[^\r\n]*[\r\n])*"
TOKEN = re.compile(
    SPACE + rb"(?:(?P<ref>\d{1,10}[\0\t\n\f\r ]+\d{1,5}[\0\t\n\f\r ]+R(?![^\0\t\n\f\r \[\]<>()/%]))|(?P<mark><<|>>|\[|\])|/(?P<name>[^\0\t\n\f\r \[\]<>(){}/%]*)"
    rb"|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<text>\()|(?P<word>[^\0\t\n\f\r \[\]<>(){}/%]+))"
)
HEADER = re.compile(SPACE + rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj")
ANY_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})[\0\t\n\f\r ]+\d{1,5}[\0\t\n\f\r ]+obj")
SECTION = re.compile(SPACE + rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,10})[\0\t\n\f\r ]*\r?\n?")
ENTRY = re.compile(rb"\s*(\d{10})[ ](\d{5})[ ]([nf])")
PARENS = re.compile(rb"\\.|[()]", re.DOTALL)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Ref(int):
    """The number of an object that is told elsewhere."""


def _unescaped(m: re.Match) -> bytes:
    return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else ESCAPED.get(m[1], m[1])


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The value at a place and where it ends. Names are str, strings bytes, dictionaries dict, references Ref."""
    m = TOKEN.match(data, at)
    if not m or depth > MOST_DEPTH:
        raise ValueError(f"no value at byte {at}")
    if m["ref"]:
        return Ref(m["ref"].split()[0]), m.end()
    if m["name"] is not None:
        return re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m["name"]).decode("latin-1"), m.end()
    if m["hex"] is not None:
        digits = b"".join(m["hex"].split())
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), m.end()
    if m["text"]:
        deep, start, at = 1, m.end(), m.end()
        while deep:
            if not (p := PARENS.search(data, at)):
                raise ValueError(f"a string at byte {start} has no end")
            deep, at = deep + {b"(": 1, b")": -1}.get(p[0], 0), p.end()
        return ESCAPE.sub(_unescaped, data[start : at - 1]), at
    if m["word"]:
        word = m["word"].decode("latin-1")
        try:
            return (int(word) if word.lstrip("+-").isdigit() else float(word)), m.end()
        except ValueError:
            return {"true": True, "false": False}.get(word), m.end()
    if m["mark"] in (b">>", b"]"):
        raise ValueError(f"nothing is open at byte {at}")
    items, at, close = [], m.end(), b">>" if m["mark"] == b"<<" else b"]"
    while not ((e := TOKEN.match(data, at)) and e["mark"] == close):
        item, at = value(data, at, depth + 1)
        items.append(item)
    return (items if close == b"]" else dict(zip(map(str, items[::2]), items[1::2]))), e.end()  # noqa: B905


def shown(v: object) -> str:
    if isinstance(v, bytes):
        if v[:2] == b"\xfe\xff":
            return v[2:].decode("utf-16-be", "replace")
        return v[3:].decode("utf-8", "replace") if v[:3] == b"\xef\xbb\xbf" else v.decode("latin-1")
    return "" if v is None else str(v)


class File:
    def __init__(self, data: bytes):
        self.data, self.error, self.trailer = data, None, {}
        #: number -> place in the file, or (object stream, index)
        self.places: dict[int, int | tuple[int, int]] = {}
        self.loaded: dict[int, tuple] = {}
        self.unpacked: dict[int, list] = {}
        try:
            self.cross_references()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError("no catalog")
        except BROKEN as e:
            self.error = f"cross-references: {e}"
            self.rebuild()
        self.hidden = "Encrypt" in self.trailer
        if self.hidden:
            self.error = "; ".join(filter(None, (self.error, "encrypted: values are not told")))

    # Where objects are.

    def cross_references(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise ValueError("no startxref")
        queue, seen = [int(self.data[at + 9 : at + 40].split()[0])], set()
        while queue:
            at = queue.pop(0)
            if at in seen:
                continue
            seen.add(at)
            m = re.compile(SPACE + rb"xref").match(self.data, at)
            trailer = self.table(m.end()) if m else self.stream_table(at)
            for key, v in trailer.items():
                self.trailer.setdefault(key, v)
            # What a hybrid file's stream tells comes before what older parts tell.
            queue += [int(trailer[k]) for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def table(self, at: int) -> dict:
        while m := SECTION.match(self.data, at):
            first, at = int(m[1]), m.end()
            for i in range(int(m[2])):
                e = ENTRY.match(self.data, at)
                if not e:
                    raise ValueError("an entry of a table is broken")
                if e[3] == b"n":
                    self.places.setdefault(first + i, int(e[1]))
                else:
                    self.places.setdefault(first + i, -1)
                at = e.end()
        m = re.compile(SPACE + rb"trailer").match(self.data, at)
        if not m:
            raise ValueError("a table has no trailer")
        trailer, _ = value(self.data, m.end())
        if not isinstance(trailer, dict):
            raise ValueError("a trailer is no dictionary")
        return trailer

    def stream_table(self, at: int) -> dict:
        d, start, end = self.parse(at)
        if not isinstance(d, dict) or d.get("Type") != "XRef" or start is None:
            raise ValueError(f"no cross-references at byte {at}")
        body, widths = self.body(d, start, end), d["W"]
        index, step, i = d.get("Index") or [0, d["Size"]], sum(widths), 0
        if len(widths) != 3 or step <= 0 or min(widths) < 0:
            raise ValueError("widths of cross-references")
        cuts = (0, widths[0], widths[0] + widths[1], step)
        for first, n in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + min(n, len(body) // step)):
                kind, a, b = (int.from_bytes(body[i + x : i + y]) for x, y in zip(cuts, cuts[1:]))  # noqa: B905
                kind = 1 if widths[0] == 0 else kind
                self.places.setdefault(number, a if kind == 1 else (a, b) if kind == 2 else -1)
                i += step
        return d

    def rebuild(self) -> None:
        """Objects by a scan of the whole file; later ones replace earlier ones, as later revisions do."""
        self.places = {int(m[1]): m.start() for m in ANY_OBJECT.finditer(self.data)}
        self.loaded, self.unpacked, self.trailer = {}, {}, {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                found, _ = value(self.data, m.end())
                self.trailer |= found if isinstance(found, dict) else {}
            except BROKEN:
                continue
        for number in list(self.places):
            d, start, _ = self.load(number)
            if isinstance(d, dict) and start is not None and d.get("Type") == "ObjStm":
                for i, (inner, _) in enumerate(self.inside(number)):
                    self.places.setdefault(inner, (number, i))
            elif isinstance(d, dict) and d.get("Type") == "XRef":
                self.trailer = d | self.trailer

    # Objects.

    def parse(self, at: int, number: int | None = None) -> tuple:
        """value, start and end of its stream or None, at a place."""
        m = HEADER.match(self.data, at)
        if not m or number is not None and int(m[1]) != number:
            raise ValueError(f"no object {'' if number is None else number} at byte {at}")
        v, end = value(self.data, m.end())
        s = re.compile(SPACE + rb"stream(?:\r\n|\n|\r)").match(self.data, end) if isinstance(v, dict) else None
        if not s:
            return v, None, None
        length = v.get("Length")
        length = self.get(length) if isinstance(length, Ref) and length != number else length
        stop = s.end() + length if isinstance(length, int) and length >= 0 else -1
        if stop < 0 or not re.compile(rb"\s*endstream").match(self.data, stop):
            stop = self.data.find(b"endstream", s.end())
            if stop < 0:
                raise ValueError(f"a stream at byte {s.end()} has no end")
            stop -= 2 if self.data[stop - 2 : stop] == b"\r\n" else self.data[stop - 1 : stop] in (b"\n", b"\r")
        return v, s.end(), stop

    def load(self, number: int) -> tuple:
        """As parse(); (None, None, None) for what isn't there or can't be read."""
        if number not in self.loaded:
            self.loaded[number] = (None, None, None)  # an object that needs itself
            place = self.places.get(number, -1)
            try:
                if isinstance(place, tuple):
                    items = self.inside(place[0])
                    if place[1] < len(items) and items[place[1]][0] == number:
                        self.loaded[number] = (items[place[1]][1], None, None)
                elif place >= 0:
                    self.loaded[number] = self.parse(place, number)
            except BROKEN as e:
                self.error = self.error or f"object {number}: {e}"
        return self.loaded[number]

    def get(self, v: object) -> object:
        for _ in range(MOST_DEPTH):
            if not isinstance(v, Ref):
                return v
            v = self.load(v)[0]
        return None

    def inside(self, number: int) -> list[tuple[int, object]]:
        """number and value of the objects that an object stream holds."""
        if number not in self.unpacked:
            self.unpacked[number] = []
            d, start, end = self.load(number)
            if isinstance(d, dict) and start is not None:
                body = self.body(d, start, end)
                first, heads = self.get(d["First"]), body[: self.get(d["First"])].split()
                self.unpacked[number] = [(int(n), value(body, first + int(at))[0]) for n, at in zip(heads[::2], heads[1::2])]  # noqa: B905
        return self.unpacked[number]

    def body(self, d: dict, start: int, end: int) -> bytes:
        """A stream's bytes, unpacked where it is deflated, with PNG's row predictors undone."""
        body, names, parms = self.data[start:end], self.get(d.get("Filter")), self.get(d.get("DecodeParms"))
        names = [] if names is None else names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms]
        for i, name in enumerate(names):
            if self.get(name) not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {self.get(name)}")
            z = zlib.decompressobj()
            body = z.decompress(body, MOST_UNPACKED)
            if z.unconsumed_tail:
                raise ValueError("a stream unpacks to too much")
            p = self.get(parms[i]) if i < len(parms) else None
            if isinstance(p, dict) and p.get("Predictor", 1) >= 10:
                body = _unpredicted(body, max(1, p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8), p.get("Columns", 1) * p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8)
        return body

    # What is told.

    def range_of(self, number: int) -> tuple[int, int]:
        """Where an object stands; for one in an object stream, where that stands."""
        place = self.places.get(number, -1)
        if isinstance(place, tuple):
            return self.range_of(place[0]) if not isinstance(self.places.get(place[0], -1), tuple) else (0, 0)
        if place < 0:
            return 0, 0
        stop = self.data.find(b"endobj", self.load(number)[2] or place)
        return place, len(self.data) if stop < 0 else stop + 6

    def information(self) -> Iterator[tuple[str, str, int, int]]:
        """key, value, start, end of the document's information."""
        info = self.trailer.get("Info")
        found = self.get(info)
        if isinstance(found, dict):
            start, end = self.range_of(info) if isinstance(info, Ref) else (0, 0)
            for key, v in found.items():
                yield key, "" if self.hidden else shown(self.get(v)), start, end

    def metadata(self) -> Iterator[tuple[int, int, bytes]]:
        """start, end and packet of every metadata stream, of the catalog, pages and images, in the file's order."""
        streams = [self.load(n) for n in self.places]
        for d, start, end in sorted((s for s in streams if isinstance(s[0], dict) and s[1] is not None and s[0].get("Type") == "Metadata"), key=lambda s: s[1]):
            try:
                yield start, end, b"" if self.hidden else self.body(d, start, end)
            except BROKEN:
                yield start, end, b""

    def stores(self) -> Iterator[tuple[int, int, bytes]]:
        """start, end and unpacked bytes of the files within the file that are claim stores."""
        for n in sorted(self.places):
            d, _, _ = self.load(n)
            if isinstance(d, dict) and self.get(d.get("AFRelationship")) == "C2PA_Manifest":
                files = self.get(d.get("EF"))
                file = files.get("F") if isinstance(files, dict) else None
                inner, start, end = self.load(file) if isinstance(file, Ref) else (None, None, None)
                if start is not None and not self.hidden:
                    yield start, end, self.body(inner, start, end)


def _unpredicted(body: bytes, unit: int, width: int) -> bytes:
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(body) - width, width + 1):
        kind, row = body[at], bytearray(body[at + 1 : at + 1 + width])
        for i in range(width):
            left, up, corner = row[i - unit] if i >= unit else 0, before[i], before[i - unit] if i >= unit else 0
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row[i] = row[i] + (0, left, up, (left + up) // 2, near)[kind] & 255
        out += row
        before = row
    return bytes(out)
