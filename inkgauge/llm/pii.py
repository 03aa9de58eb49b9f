"""Surrogates for personal data: keyed replacements of the same type, format, script and gender.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment cards (with a valid check digit and a known
first digit), social security numbers, access keys, assigned secrets, and persons: a title or several, or a known given name, before
capitalised names, initials and particles, as many as there are, with hyphens and apostrophes; and, in the same text, every bare mention
of a name so found.

A surrogate is a keyed permutation of its original: letters, digits and the vowels and consonants of names are taken as
digits of a number of mixed radix, a Feistel network permutes the numbers below the product of the radices, and the
result is written in the original's format. Different originals of one shape so have different surrogates, and the same
original has the same one everywhere, in whatever format it is written. Cards get a valid check digit, addresses valid
octets, domains end in ".example". Given names are permuted within those of their gender and script; endings of gendered
Cyrillic surnames stay. Parts of a person's name are replaced part by part, so short mentions agree with long ones.

Letters of other scripts change among those of one Unicode category in their block, so no letter of any script stays fixed.

Collisions are checked nonetheless, over the whole corpus: distinct entities are grouped by surrogate, and those that
share one, or whose surrogate is an original of its type anywhere in the corpus, get the first later attempt that is free. Later attempts
lengthen a surrogate, so a shape of which every form is taken ends too; attempts go on until each entity is alone. Only a given name may
be another person's: it is one of a short public list, and the surname beside it is nobody's. Only these exceptions,
usually few, meet the documents again.

Texts are read twice, whole, row by row. Defined results: null text stays null, without entities; an empty table gives no
rows; extra columns stay, but for those named like what is added; rows are matched with their exceptions by their text, so ids
may be null or repeated; empty texts stay empty, texts of any length are searched whole. Persons are found by titles and a list of given
names, so a name with neither stays, unless the same text has it elsewhere with one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import join_small, written

#: Attempts that are offered at a time, and the last one of a surrogate's own length.
ATTEMPTS, OWN_LENGTH = 8, 8
#: Longer values are permuted part by part.
PART = 256
#: Given names by gender and script.
NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carmen Caroline Catherine Charlotte Christine Claire Clara Daniela Elena Elizabeth Emily Emma Eva Grace Hannah Helen Ines Irene Isabel Jane Jennifer Jessica Julia Karen Laura Linda Louise Lucia Lucy Margaret Maria Marie Marta Mary Monica Natalie Nicole Olivia Patricia Paula Rachel Rebecca Rosa Ruth Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("m", "latin"): "Adam Albert Alexander Andrew Anthony Antonio Arthur Benjamin Bernard Carlos Charles Christopher Daniel David Diego Edward Eric Felix Francis Frank Frederick George Hans Henry Hugo Jack James Javier John Jonas Joseph Juan Karl Kevin Leon Louis Lucas Manuel Marco Martin Matthew Michael Miguel Nicholas Oliver Oscar Otto Patrick Paul Pedro Peter Philip Richard Robert Samuel Simon Stephen Thomas Victor Walter William".split(),
    ("f", "cyrillic"): "Александра Алина Анастасия Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Марина Мария Надежда Наталья Оксана Ольга Светлана София Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Антон Борис Вадим Василий Виктор Владимир Григорий Денис Дмитрий Евгений Иван Игорь Кирилл Константин Максим Михаил Николай Олег Павел Пётр Роман Сергей Юрий".split(),
}
#: Titles by gender; "" says nothing of it.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "господин": "m", "госпожа": "f"}
#: Endings of Russian surnames that show gender.
ENDINGS = ("ский", "ская", "ова", "ева", "ина", "ов", "ев", "ин")
CLASSES = [
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ",
]
PLAIN = ["0123456789", "abcdefghijklmnopqrstuvwxyz"]
HEX = ["0123456789abcdef"]

GIVEN = {n: k for k, names in NAMES.items() for n in names}
LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9])?$")
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w+.\-])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|(?<![\d])\d{3}[.\-])\d{3}[ .\-]\d{4}(?![\w\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?![\w\-])")
CARD = re.compile(r"(?<![\w.\-])\d{3,19}(?:[ \-]\d{1,19}){0,8}(?![\w\-])")
SSN = re.compile(r"(?<![\w\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-])")
AWS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i)(?<![A-Za-z])(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9_\-+/]{16,})")
_title = "(?:" + "|".join(TITLES) + r")\.?"
#: What a person's mention begins with: titles, joined or one after the other, or a given name.
PERSON = re.compile(rf"(?<!\w)(?:(?P<titles>{_title}(?:(?: (?:and|or|&|und|et|y|и))? {_title}(?!\w))*)|(?P<given>" + "|".join(GIVEN) + r"))(?!\w)")
#: The next part of a name, and what stands small between parts.
STEP = re.compile(r" ([^\W\d_]+(?:['’\-][^\W\d_]+)*)(\.?)")
PARTICLES = frozenset("al bin da dal de del della den der di dos du el la le ten ter van von y zu".split())
MOST_PARTS = 12
#: What a name or title of a capital begins with; titles without one are looked for by themselves.
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞЀ-Я][^\W\d_]*")
SMALL_TITLES = tuple(t for t in TITLES if t[0].islower())
DIGIT, NAMED = re.compile(r"\d"), frozenset(TITLES) | frozenset(GIVEN)
CARD_FIRST = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")


def luhn(digits: str) -> int:
    """The sum that is divisible by ten for valid numbers."""
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])


@lru_cache(4096)
def letters_like(ch: str) -> str:
    """The letters of ch's category in its block of 128 characters; those whose case can be changed and back apart from the others."""

    def kind(c: str) -> tuple[str, bool]:
        return unicodedata.category(c), len(c.upper()) == 1 and c.upper().lower() == c

    first, own = ord(ch) & ~127, kind(ch)
    listed = "".join(CLASSES)  # so that each letter is of one class, and a surrogate has its original's shape
    return "".join(c for c in map(chr, range(first, first + 128)) if c == ch or kind(c) == own and c not in listed)


class Permuter:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, value: int, bits: int) -> int:
        out, block = b"", 0
        n = (bits + 7) // 8
        while len(out) < n:
            out += hmac.new(self.key, b"%b|%d|%d|%d|%x" % (tweak, r, block, bits, value), hashlib.sha256).digest()
            block += 1
        return int.from_bytes(out[:n], "big") & ((1 << bits) - 1)

    def __call__(self, x: int, bound: int, tweak: bytes) -> int:
        """Another number below bound: a Feistel network over the next even number of bits, walked until it is below."""
        if bound < 2:
            return x
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(8):
                a, b = b, a ^ self._round(tweak, r, b, half)
            x = a << half | b
            if x < bound:
                return x

    def text(self, value: str, classes: list[str], tweak: bytes) -> str:
        """value, each character replaced by one of its class, letters of no class by ones of their script; others stay.

        Long values are permuted part by part, each under a key that the parts before it set, so that no two values meet.
        """
        if len(value) > PART:
            out = []
            for at in range(0, len(value), PART):
                part = value[at : at + PART]
                out.append(self.text(part, classes, tweak))
                tweak = hashlib.sha256(tweak + b"|part|" + part.encode()).digest()
            return "".join(out)
        kinds = [next((c for c in classes if ch in c), "") or (letters_like(ch) if ch.isalpha() else "") for ch in value]
        x, bound = 0, 1
        for ch, c in zip(value, kinds, strict=True):
            if c:
                x, bound = x * len(c) + c.index(ch), bound * len(c)
        shape = "".join(c[0] if c else ch for ch, c in zip(value, kinds, strict=True))
        x = self(x, bound, tweak + b"|" + shape.encode())
        out = []
        for ch, c in zip(reversed(value), reversed(kinds), strict=True):
            if c:
                x, i = divmod(x, len(c))
                ch = c[i]
            out.append(ch)
        return "".join(reversed(out))

    def more(self, value: str, tweak: bytes, n: int) -> str:
        """n letters that depend on value."""
        h = int.from_bytes(hmac.new(self.key, b"more|" + tweak + b"|" + value.encode(), hashlib.sha256).digest(), "big")
        return "".join("abcdefghijklmnopqrstuvwxyz"[h // 26**i % 26] for i in range(n))


def recased(new: str, like: str) -> str:
    return "".join(n.upper() if o.isupper() else n for n, o in zip(new, like, strict=True))


def _find_emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        left = LOCAL.search(text, max(0, at - 64), at)
        right = DOMAIN.match(text, at + 1)
        if left and right and left.end() == at:
            yield left.start(), right.end()
        at = text.find("@", at + 1)


def _find_persons(text: str) -> Iterator[re.Match]:
    """PERSON's matches, tried only where a listed word stands."""
    if any(t in text for t in SMALL_TITLES):
        yield from PERSON.finditer(text)
        return
    end = 0
    for m in CAPITAL.finditer(text):
        if m[0] in NAMED and m.start() >= end and (found := PERSON.match(text, m.start())):
            end = found.end()
            yield found


def _name_parts(text: str, at: int) -> list[tuple[int, int, bool]]:
    """start, end of the capitalised parts of a name that goes on at `at`, and whether it is an initial: one letter before a full stop or another part."""
    out = []
    for _ in range(MOST_PARTS):
        if not (m := STEP.match(text, at)):
            break
        start, end = m.span(1)
        if m[1][0].isupper():
            owned = m[1][-2:] in ("'s", "’s") and len(m[1]) > 2
            out.append((start, end - 2 * owned, end - start == 1 and m[2] == "."))
            # A full stop behind an initial is its own; behind a name, and behind a possessive, the mention ends.
            if owned or m[2] and end - start > 1:
                break
            at = m.end()
        elif m[1] in PARTICLES and not m[2]:
            at = end
        else:
            break
    return [(a, b, dot or b - a == 1 and k < len(out) - 1) for k, (a, b, dot) in enumerate(out)]


def _persons(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, type and normal form of the parts of each mention, those of hyphenated names apart, and of bare mentions of the same names."""
    out, end, known = [], 0, {}
    for lead in _find_persons(text):
        if lead.start() < end:
            continue
        parts = _name_parts(text, lead.end())
        if lead["given"]:
            first = re.compile(r"(?:-[^\W\d_]+)*").match(text, lead.end()).end()
            parts = [(lead.start(), first, False), *_name_parts(text, first)]
        full = [p for p in parts if not p[2]]
        if len(full) < 1 + bool(lead["given"]):
            continue
        end = parts[-1][1]
        titles = {TITLES[t] for t in re.findall(r"[^\W\d_]+", lead["titles"] or "") if t in TITLES} - {""}
        gender = titles.pop() if len(titles) == 1 else ""
        alone = len(parts) == 1
        for p in parts:
            at = p[0]
            for word in text[p[0] : p[1]].split("-"):
                own = GIVEN.get(word)
                given = own if alone else own or p[2] or (p == full[0] and p != full[-1])
                if p == full[-1] and not alone:
                    given = False
                if given:
                    script = "cyrillic" if "а" <= word[0].lower() <= "я" else "latin"
                    kind, norm = "given", f"{'/'.join(own or (gender or 'm', script))}/{word}"
                else:
                    kind, norm = "surname", word.lower()
                out.append((at, at + len(word), kind, norm))
                if len(word) > 1:
                    for form in (word, word.upper()):
                        known.setdefault(form, (kind, norm))
                at += len(word) + 1
    for form, (kind, norm) in known.items():
        at = text.find(form)
        while at >= 0:
            stop = at + len(form)
            joins = lambda c: c.isalnum() or c == "_"
            if not (at and joins(text[at - 1])) and not (stop < len(text) and joins(text[stop])):
                out.append((at, stop, kind, norm))
            at = text.find(form, stop)
    return out


def _cards(text: str, start: int, groups: list[str]) -> tuple[int, int, str] | None:
    """The longest run of digit groups that is a card's number."""
    places, at = [], start
    for g in groups:
        places.append(at)
        at += len(g) + 1
    for i in range(len(groups)):
        for j in range(len(groups), i, -1):
            digits = "".join(groups[i:j])
            if 13 <= len(digits) <= 19 and CARD_FIRST.match(digits) and luhn(digits) % 10 == 0:
                return places[i], places[j - 1] + len(groups[j - 1]), digits
    return None


def _numbers(text: str, add: Callable[[int, int, int, str, str], None]) -> None:
    if text.count(".") > 2:
        for m in IP.finditer(text):
            add(3, *m.span(), "ip", m[0])
    for m in CARD.finditer(text):
        if len(m[0]) >= 13 and (card := _cards(text, m.start(), re.split(r"[ \-]", m[0]))):
            add(4, *card[:2], "card", card[2])
    if not any(c in text for c in "-+.("):
        return
    for m in PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        # Ten digits without a country code are the same number as those after +1.
        add(5, *m.span(), "phone", digits[1:] if m[0][0] == "+" and len(digits) == 11 and digits[0] == "1" else digits)
    if "-" in text:
        for m in SSN.finditer(text):
            add(6, *m.span(), "ssn", m[0].replace("-", ""))


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, type and normal form of each entity, in order and without overlap."""
    found: list[tuple[int, int, int, str, str]] = []

    def add(rank: int, start: int, end: int, kind: str, norm: str) -> None:
        found.append((start, rank, end, kind, norm))

    # Each pattern needs something that a plain search finds faster, and most texts lack.
    numbers = DIGIT.search(text) is not None
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            # A word alone behind a colon is prose; what has digits, capitals inside, or an equals sign before it is a secret.
            if any(c.isdigit() or c.isupper() for c in m[1][1:]) or "=" in text[m.start() : m.start(1)]:
                add(0, *m.span(1), "secret", m[1])
    if "AKIA" in text or "ASIA" in text:
        for m in AWS.finditer(text):
            add(1, *m.span(), "access_key", m[0])
    if "@" in text:
        for a, b in _find_emails(text):
            add(2, a, b, "email", text[a:b].lower())
    if numbers:
        _numbers(text, add)
    for start, end, kind, norm in _persons(text):
        add(7, start, end, kind, norm)
    out, end = [], 0
    for start, _, stop, kind, norm in sorted(found):
        if start >= end:
            out.append((start, stop, kind, norm))
            end = stop
    return out


class Surrogates:
    """Normal forms to surrogates' normal forms, and those written like an original."""

    def __init__(self, key: bytes):
        self.permute = Permuter(key)
        self.table: dict[tuple[str, str, int], str] = {}
        self.cycles: dict[tuple[str, str, int], dict[str, str]] = {}

    def _cycle(self, gender: str, script: str, attempt: int) -> dict[str, str]:
        """Each name of a gender and script to the next in a keyed order."""
        k = (gender, script, attempt)
        if k not in self.cycles:
            names = sorted(NAMES[gender, script], key=lambda n: hmac.new(self.permute.key, f"{attempt}|{n}".encode(), hashlib.sha256).digest())
            self.cycles[k] = dict(zip(names, names[1:] + names[:1], strict=True))
        return self.cycles[k]

    def make(self, kind: str, norm: str, attempt: int = 0) -> str:
        k = (kind, norm, attempt)
        if k not in self.table:
            if len(self.table) > 100_000:
                self.table.clear()
            self.table[k] = self._made(kind, norm, f"{kind}|{attempt}".encode())
        return self.table[k]

    def _made(self, kind: str, norm: str, tweak: bytes) -> str:
        p, attempt = self.permute, int(tweak.rsplit(b"|", 1)[1])
        if kind in ("given", "surname", "email", "secret") and attempt > OWN_LENGTH:
            # Room for every entity of a shape whose forms are all taken.
            more = p.more(norm, tweak, min(2 * (attempt - OWN_LENGTH), 40))
            if kind != "email":
                return self._made(kind, norm, f"{kind}|0".encode()) + more
            local, domain = self._made(kind, norm, f"{kind}|0".encode()).rsplit("@", 1)
            return f"{local}@{more}.{domain}"
        if kind in ("phone", "ssn"):
            return p.text(norm, PLAIN[:1], tweak)
        if kind == "card":
            body = norm[0] + p.text(norm[1:-1], PLAIN[:1], tweak + norm[0].encode())
            return body + str(-luhn(body + "0") % 10)
        if kind == "ip":
            x = 0
            for part in norm.split("."):
                x = x << 8 | int(part)
            x = p(x, 1 << 32, tweak)
            return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        if kind == "access_key":
            return norm[:4] + p.text(norm[4:], ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], tweak)
        if kind == "secret":
            low = norm.lower()
            classes = HEX if re.fullmatch(r"[0-9a-f]+", low) and norm in (low, norm.upper()) else PLAIN
            if classes is HEX:
                return recased(p.text(low, classes, tweak), norm) if norm == low else p.text(low, classes, tweak).upper()
            return p.text(norm, [*PLAIN, PLAIN[1].upper()], tweak)
        if kind == "email":
            local, domain = norm.rsplit("@", 1)
            labels = domain.split(".")
            hidden = p.text(".".join(labels[:-1]), PLAIN, tweak + b"|domain|" + labels[-1].encode())
            top = "" if labels[-1] == "example" else f".{labels[-1]}"
            return f"{p.text(local, PLAIN, tweak + domain.encode())}@{hidden}{top}.example"
        if kind == "given":
            gender, script, name = norm.split("/", 2)
            known = self._cycle(gender, script, attempt)
            return f"{gender}/{script}/{known.get(name) or self._other_name(name, tweak)}"
        end = next((e for e in ENDINGS if norm.endswith(e) and len(norm) > len(e) + 1), "")
        stem = norm[: len(norm) - len(end)]
        # The vowels and consonants of a name change among themselves; its first letter stays a capital.
        return p.text(stem, CLASSES, tweak) + end

    def _other_name(self, name: str, tweak: bytes) -> str:
        return recased(self.permute.text(name.lower(), CLASSES, tweak), name) if len(name.lower()) == len(name) else name

    def written(self, kind: str, norm: str, new: str, original: str) -> str:
        """new in the original's format."""
        if kind in ("phone", "ssn", "card"):
            digits = iter(new)
            skip = sum(c.isdigit() for c in original) - len(new)
            out = []
            for c in original:
                if c.isdigit() and skip > 0:
                    skip -= 1
                elif c.isdigit():
                    c = next(digits)
                out.append(c)
            return "".join(out)
        if kind == "given":
            name = new.split("/", 2)[2]
            return name.upper() if len(original) > 1 and original == original.upper() != original.lower() else name
        if kind == "email":
            local = original.rsplit("@", 1)[0]
            n = len(local)
            return recased(new[:n], local) + new[n:]
        if kind == "surname":
            return recased(new, original) if len(new) == len(original) else new.capitalize()
        return new


ENTITY = "array<struct<type:string,start:int,end:int,norm:string,made:string,surrogate:string>>"
ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("norm", pa.string()), ("made", pa.string()), ("surrogate", pa.string())]))


def replaced(text: str, makers: Surrogates, exceptions: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    """text with its entities replaced; start and end are places in the original."""
    out, at, entities = [], 0, []
    for start, end, kind, norm in detect(text):
        new = makers.make(kind, norm, exceptions.get((kind, norm), 0))
        shown = makers.written(kind, norm, new, text[start:end])
        out += [text[at:start], shown]
        at = end
        entities.append({"type": kind, "start": start, "end": end, "norm": norm, "made": new, "surrogate": shown})
    return "".join([*out, text[at:]]), entities


def _mapped(docs: DataFrame, text_col: str, key: bytes, attempts: str | None) -> DataFrame:
    """docs with __text and __entities; attempts: a column of exceptions (type, norm, attempt)."""
    names = docs.columns
    schema = StructType([*docs.schema.fields]).add("__text", "string").add("__entities", StructType.fromDDL(f"x {ENTITY}")["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = Surrogates(key)
        for batch in batches:
            texts, entities = [], []
            known = batch.column(attempts) if attempts else [None] * len(batch)
            for t, x in zip(batch.column(text_col), known, strict=True):
                t, x = t.as_py(), (x.as_py() if x is not None else None) or ()
                new, found = (None, []) if t is None else replaced(t, makers, {(e["type"], e["norm"]): e["attempt"] for e in x})
                texts.append(new)
                entities.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(entities, ARROW)], names=[*names, "__text", "__entities"])

    return docs.mapInArrow(run, schema)


def collisions(entities: DataFrame, key: bytes, remade: Callable[[str, str, int], str] | None = None) -> DataFrame:
    """entities(type, norm, made) -> type, norm, attempt, made for those whose surrogate isn't theirs alone.

    Taken are all originals of a type (of given names only the entity's own) and what others hold. Attempts are offered in rounds, a
    written table each, until every entity has one; nothing of them comes to the driver but a count.
    """
    make = remade or Surrogates(key).make
    distinct = written(entities.distinct(), "entities")
    originals = distinct.where("type != 'given'").select("type", F.col("norm").alias("made"))
    shared = distinct.groupBy("type", "made").agg(F.count("*").alias("n"), F.min("norm").alias("first")).where("n > 1")
    left = written(
        distinct.join(shared, ["type", "made"]).where("norm != first").select("type", "norm")
        .union(distinct.join(originals, ["type", "made"], "left_semi").select("type", "norm"))
        .union(distinct.where("norm = made").select("type", "norm"))
        .distinct(),
        "clashes",
    )
    taken = distinct.select("type", "made").union(originals)
    names = ["type", "norm", "attempt", "made"]
    done = distinct.sparkSession.createDataFrame([], "type string, norm string, attempt int, made string")

    def offers(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 10_000):
                    part = batch.slice(at, 10_000)
                    rows = [
                        (t, n, a, make(t, n, a))
                        for t, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                        for a in range(first, first + ATTEMPTS)
                    ]
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    first = 1
    while left.count():
        offered = written(left.mapInArrow(offers(first), "type string, norm string, attempt int, made string"), "tries")
        free = offered.join(taken, ["type", "made"], "left_anti").join(done.select("type", "made"), ["type", "made"], "left_anti").where("norm != made")
        # Of those that would share an attempt the first keeps it, and each entity takes its first free one.
        owner = free.groupBy("type", "made").agg(F.min("norm").alias("norm"))
        won = free.join(owner, ["type", "made", "norm"]).groupBy("type", "norm").agg(F.min(F.struct("attempt", "made")).alias("w"))
        done = written(done.union(won.select("type", "norm", "w.attempt", "w.made")), "exceptions")
        left = written(left.join(done, ["type", "norm"], "left_anti"), "clashes")
        first += ATTEMPTS
    return done


def surrogate_documents(docs: DataFrame, key: bytes | str, *, text_col: str = "text") -> DataFrame:
    """docs with text replaced, original_text left out, and entities (type, start, end, surrogate)."""
    key = key.encode() if isinstance(key, str) else key
    name = F.sha2(F.col(text_col).cast("string"), 256)  # equal texts have equal exceptions
    first = _mapped(docs.select(name.alias("__id"), F.col(text_col).alias("__t")), "__t", key, None)
    seen = written(first.select("__id", F.explode("__entities").alias("e")).select("__id", "e.type", "e.norm", "e.made"), "found")
    again = written(collisions(seen.select("type", "norm", "made"), key).drop("made"), "exceptions")
    by_text = join_small(seen.select("__id", "type", "norm").distinct(), again, ["type", "norm"], "inner").groupBy("__id").agg(
        F.collect_list(F.struct("type", "norm", "attempt")).alias("__again")
    )
    told = join_small(docs.drop("entities").withColumn("__id", name), by_text, ["__id"])
    e = lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["surrogate"].alias("surrogate"))
    out = _mapped(told, text_col, key, "__again")
    return out.select(
        *[F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "entities"],
        F.transform("__entities", e).alias("entities"),
    )
