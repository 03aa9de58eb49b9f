"""Text as columns: tokens, sentences, paragraphs, n-grams, windows. Everything is local to a row: nothing is shuffled.

Patterns name their character classes, so that Java, RE2 and Python agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with an apostrophe inside, numbers with a point inside, or one other visible character.
TOKEN = r"[\p{L}\p{Nl}\p{No}]+(?:'[\p{L}\p{Nl}\p{No}]+)?|\p{Nd}+(?:\.\p{Nd}+)?|[^\t-\r\x1c-\x20\x{85}\p{Z}\p{L}\p{N}_]"
#: The inside of a class of white space.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
SENTENCE_END = rf"(?<=[.!?])[{SPACE}]+(?=[\"'(A-Z0-9])"
URL = r"(?i)https?://[^\t-\r\x1c-\x20\x{85}\p{Z})>\]]+"
EMAIL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.\-]*[\p{L}\p{N}_]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: What ends a line, besides \r\n.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def sanitize(c: Column, hard_max: int | None = None) -> Column:
    """Without control characters but tab and line ends; over hard_max characters it is null."""
    clean = F.regexp_replace(c, CONTROL, "")
    return clean if hard_max is None else F.when(F.length(c) <= hard_max, clean)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def is_word(t: Column) -> Column:
    return t.rlike(r"^\p{L}")


def kind(t: Column) -> Column:
    return F.when(is_word(t), "word").when(t.rlike(r"^\p{Nd}"), "number").otherwise("punct")


def words(c: Column) -> Column:
    return F.filter(tokens(c), is_word)


def lower_words(c: Column) -> Column:
    return F.transform(words(c), F.lower)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), SENTENCE_END), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"\n[{SPACE}]*\n"), strip), lambda s: s != "")


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once, however often f uses it and in whatever lambda."""
    return F.transform(F.array(value), f)[0]


def ngrams(items: Column, n: int) -> Column:
    """Contiguous runs of n items, joined by U+001F."""
    rest = [F.slice(items, k + 1, F.greatest(F.size(items) - n + 1, F.lit(0))) for k in range(n)]
    zipped = rest[0]
    for r in rest[1:]:
        zipped = F.zip_with(zipped, r, lambda a, b: F.concat_ws("\x1f", a, b))
    return zipped


def flat(c: Column) -> Column:
    """The lower-cased text with single blanks."""
    return F.regexp_replace(F.lower(c), rf"[{SPACE}]+", " ")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Runs of n characters of the lower-cased text with single blanks; a shorter text is its own run."""

    def runs(chars: Column) -> Column:
        rest = [F.slice(chars, k + 1, F.greatest(F.size(chars) - n + 1, F.lit(0))) for k in range(n)]
        out = rest[0]
        for r in rest[1:]:
            out = F.zip_with(out, r, lambda a, b: F.concat(a, b))
        return F.when(F.size(chars) >= n, out).when(F.size(chars) > 0, F.array(F.array_join(chars, ""))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(flat(c), ""), lambda x: x != ""), runs)


def window_starts(n: Column, window: int, stride: int) -> Column:
    """The starts of windows over n items: one if all fit, else by stride until one reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(stride))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * stride)


def sliding_windows(items: Column, window: int, stride: int) -> Column:
    return F.transform(window_starts(F.size(items), window, stride), lambda s: F.slice(items, s + 1, window))


def protected_spans(c: Column) -> Column:
    """URLs and addresses in the text."""
    return F.concat(F.regexp_extract_all(c, F.lit(URL), F.lit(0)), F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)))


def _places(c: Column, pattern: str) -> Column:
    """Structs of start and end of a pattern's matches: what lies between them and they themselves, laid end to end."""
    gaps, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    span = "struct<start:int,end:int>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def put(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    laid = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(laid, first, put, lambda a: a["out"])


def protected_offsets(c: Column) -> Column:
    """Structs of start and end of URLs and addresses in the text, in order; those that touch or overlap are one."""
    span = "array<struct<start:int,end:int>>"

    def merge(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))
        return F.when((F.size(out) > 0) & (x["start"] <= F.coalesce(last["end"], F.lit(-1))), joined).otherwise(F.array_append(out, x))

    return F.aggregate(F.array_sort(F.concat(_places(c, URL), _places(c, EMAIL))), F.array().cast(span), merge)


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether [start, end) overlaps one of spans (structs of start and end)."""
    return F.exists(spans, lambda s: (start < s["end"]) & (s["start"] < end))


def prose_chunks(block: Column, limit: int = 3500) -> Column:
    """Paragraphs packed into chunks of `limit` characters, separators kept; concatenated they are the block again."""
    marked = F.split(F.regexp_replace(block, r"(\n\s*\n)", "$1\u0001"), "\u0001")
    start = F.array().cast("array<string>")

    def add(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(F.coalesce(last, F.lit(""))) + F.length(part) <= limit)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, part)))
        return F.when(fits, joined).otherwise(F.array_append(acc, part))

    return F.filter(F.aggregate(marked, start, lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(add(a, p))), lambda x: x != "")


def match_casing(source: Column, word: Column) -> Column:
    """word in source's casing: all capitals, a first capital, or as it is."""
    first = F.substr(source, F.lit(1), F.lit(1))
    capital = F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.substr(word, F.lit(2)))
    shouted = (source == F.upper(source)) & (source != F.lower(source))
    return F.when(shouted, F.upper(word)).when((first == F.upper(first)) & (first != F.lower(first)), capital).otherwise(word)


def join_sentences(sents: Column) -> Column:
    """Sentences joined by blanks; all but the last get a full stop where they have no end mark."""
    full = F.filter(F.transform(sents, strip), lambda s: s != "")
    ended = F.transform(
        full,
        lambda s, i: F.when((i == F.size(full) - 1) | F.substr(s, F.lit(-1), F.lit(1)).isin(".", "!", "?", ":", ";"), s).otherwise(F.concat(s, F.lit("."))),
    )
    return F.array_join(ended, " ")


def syllables(word: Column) -> Column:
    """Vowel groups of the ASCII letters without a final e; 1 at least, 0 without letters."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(F.regexp_replace(letters, "e$", ""), F.lit("[aeiouy]+"))
    return F.when(letters == "", 0).otherwise(F.greatest(F.lit(1), groups))


def total_syllables(words: Column) -> Column:
    """The sum of syllables() over an array of words, by a few passes over all of them joined."""
    letters = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z ]", "")
    bare = F.regexp_replace(letters, "e(?= |$)", "")
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    # A word without a vowel group counts as one.
    return count(bare, "[aeiouy]+") + count(letters, "[a-z]+") - count(bare, "[b-df-hj-np-tv-xz]*[aeiouy][a-z]*")


def reconstruct(c: Column, edits: Column) -> Column:
    """The text with edits (structs of start, end, new) applied from the last; invalid ones and those that overlap a later one are left out."""
    falling = F.reverse(F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["new"].alias("new")))))
    first = F.struct(F.lit("").alias("out"), F.length(c).alias("at"))

    def put(a: Column, e: Column) -> Column:
        valid = (e["start"] >= 0) & (e["start"] <= e["end"]) & (e["end"] <= a["at"])
        tail = F.concat(e["new"], F.substr(c, e["end"] + 1, a["at"] - e["end"]), a["out"])
        return F.when(valid, F.struct(tail.alias("out"), e["start"].alias("at"))).otherwise(a)

    return F.aggregate(falling, first, put, lambda a: F.concat(F.substr(c, F.lit(1), a["at"]), a["out"]))
