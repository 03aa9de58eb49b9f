"""The features of features.py and the counts of pairs, for whole batches of texts at once.

Patterns and folds over arrays are not compiled in the JVM. Here a batch's texts are one array of characters, its words
one array of numbers, and what is counted is counted by sorts. A text's values don't depend on its batch, but for the order
of sums.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import lexicon
from . import maths as M

#: So many bytes of text are in hand at once, or one text.
BATCH_BYTES = 1 << 21
SPACE, LOW_LINE, LETTER, OTHER_NUMBER, DIGIT, VISIBLE, UNKNOWN = 0, 1, 2, 3, 4, 5, 255
#: Letters whose lower case is two characters, or another one at a word's end.
CONTEXT = "\u0130\u03a3"
#: By character: its class and its lower case (but of CONTEXT), as they are met.
_classes, _lower = np.full(0x110000, UNKNOWN, np.uint8), np.arange(0x110000, dtype=np.uint32)


def _class(c: str) -> int:
    """As in text.TOKEN."""
    kind = unicodedata.category(c)
    if kind[0] == "Z" or c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85":
        return SPACE
    return {"Nl": OTHER_NUMBER, "No": OTHER_NUMBER, "Nd": DIGIT}.get(kind, LETTER if kind[0] == "L" else LOW_LINE if c == "_" else VISIBLE)


def classes(codes: np.ndarray) -> np.ndarray:
    out = _classes[codes]
    if (out == UNKNOWN).any():
        for c in np.unique(codes[out == UNKNOWN]).tolist():
            _classes[c] = _class(chr(c))
            if chr(c) not in CONTEXT:
                _lower[c] = ord(chr(c).lower())
        out = _classes[codes]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def batches(*columns: pa.Array) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Rows of text columns in pieces of BATCH_BYTES at most, with their numbers; null is an empty text. Those of ASCII alone come first:
    their characters are bytes."""
    columns = [pc.fill_null(c, "") for c in columns]
    plain = np.logical_and.reduce([pc.string_is_ascii(c).to_numpy(zero_copy_only=False).astype(bool) for c in columns])
    for rows in (np.flatnonzero(plain), np.flatnonzero(~plain)):
        ends, at = np.cumsum(sum(pc.binary_length(c).to_numpy().astype(np.int64) for c in columns)[rows]), 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
            own = pa.array(rows[at:upto])
            yield own, [c.take(own).to_pylist() for c in columns]
            at = upto


def _in_order(parts: list[pa.Array], rows: list[pa.Array]) -> pa.Array:
    """What was made of batches(), by the rows' numbers."""
    return pa.concat_arrays(parts).take(pc.array_sort_indices(pa.concat_arrays(rows)))


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    padded = np.zeros(len(flags) + 2, bool)
    padded[1:-1] = flags
    at = np.flatnonzero(padded[1:] != padded[:-1])
    return at[::2], at[1::2]


def _within(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return sums[ends] - sums[starts]


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums, with 0 before the first."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's runs of equal values begin."""
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return np.flatnonzero(first)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unlike values in order, and how often each is there; x itself is sorted."""
    x.sort()
    at = _firsts(x)
    return x[at], np.diff(at, append=len(x))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two sorted arrays of unlike values have in common."""
    x = np.concatenate([a, b])
    x.sort(kind="stable")  # merges
    return x[:-1][x[1:] == x[:-1]]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1e-300), 0.0)


def _clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


@dataclass
class Cut:
    """Words and sentences of some texts: word ids by text, ids' words, each text's words (n) and sentences, and where they begin."""

    raws: list[str]
    codes: np.ndarray
    kinds: np.ndarray
    chars: np.ndarray  # where texts begin in codes; one more at the end, each text is followed by one character
    ids: np.ndarray
    words: pa.Array
    n: np.ndarray
    first_word: np.ndarray
    doc: np.ndarray  # of each word
    numbers: np.ndarray  # whether a text has numbers that are no digits
    sents: np.ndarray
    first_sent: np.ndarray
    sent_start: np.ndarray
    sent_end: np.ndarray
    sent_words: np.ndarray
    sent_doc: np.ndarray

    @property
    def bits(self) -> int:
        """Of an id, and of one more that no word has."""
        return max(1, len(self.words).bit_length())


def _lowered(words: pa.Array, ids: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case, where only CONTEXT is left to do."""
    odd = np.flatnonzero(pc.match_substring_regex(words, f"[{CONTEXT}]").to_numpy(zero_copy_only=False))
    if not len(odd):
        return words, ids
    plain = words.to_pylist()
    for k in odd.tolist():
        plain[k] = plain[k].lower()
    known = pa.array(plain, pa.string()).dictionary_encode()
    return known.dictionary, known.indices.to_numpy()[ids]


def cut(texts: list[str]) -> Cut:
    """The words of text.lower_words() and the sentences of text.sentences()."""
    raws = [t.strip() for t in texts]
    codes = _codes("\n" + "\n".join(raws) + "\n")
    chars = 1 + _sums(np.array([len(r) + 1 for r in raws], np.int64))
    kinds = classes(codes)
    letters = kinds == LETTER
    other = kinds == OTHER_NUMBER
    numbers = _within(_sums(other), chars[:-1], chars[1:]) > 0 if other.any() else np.zeros(len(raws), bool)
    start, end = _edges(letters | other)
    if len(start):
        # Two runs with an apostrophe between them are one word; of a chain of them, the first two, the next two...
        meets = (end[:-1] + 1 == start[1:]) & (codes[end[:-1]] == 0x27)
        at = np.arange(len(meets))
        joined = meets & ((at - np.maximum.accumulate(np.where(meets, 0, at + 1))) % 2 == 0) if len(meets) else meets
        end = np.where(np.append(joined, False), np.append(end[1:], 0), end)
        own = ~np.insert(joined, 0, False) & letters[start]
        start, end = start[own], end[own]
    sizes = end - start
    mark = np.zeros(len(codes) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    inside = _lower[codes[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]].astype(codes.dtype)
    if codes.dtype == np.uint8:
        data, offsets = inside.tobytes(), _sums(sizes)
    else:
        width = 1 + (inside > 0x7F).astype(np.int8) + (inside > 0x7FF) + (inside > 0xFFFF)
        data, offsets = inside.tobytes().decode("utf-32-le", "surrogatepass").encode(), _sums(width)[_sums(sizes)]
    found = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    words, ids = _lowered(found.dictionary.cast(pa.string()), found.indices.to_numpy())
    first_word = np.searchsorted(start, chars)
    n = np.diff(first_word)
    # A sentence ends at white space behind an end mark, if it goes on with a capital, a digit, a quote or a parenthesis.
    gap, over = _edges(kinds == SPACE)
    gap, over = gap[:-1], over[:-1]
    before, after = codes[np.maximum(gap - 1, 0)], codes[over]
    ends = ((before == 0x2E) | (before == 0x21) | (before == 0x3F)) & (
        (after == 0x22) | (after == 0x27) | (after == 0x28) | ((after >= 65) & (after <= 90)) | ((after >= 48) & (after <= 57))
    )
    between = np.zeros(len(codes), bool)
    between[chars - 1] = True
    ends &= ~between[gap]
    full = np.diff(chars) > 1
    sent_start = np.sort(np.concatenate([chars[:-1][full], over[ends]]))
    sent_end = np.sort(np.concatenate([chars[1:][full] - 1, gap[ends]]))
    first_sent = np.searchsorted(sent_start, chars)
    sents = np.diff(first_sent)
    sent_words = np.diff(np.searchsorted(start, np.append(sent_start, len(codes))))
    rows = np.arange(len(raws))
    return Cut(raws, codes, kinds, chars, ids.astype(np.int64), words, n, first_word, np.repeat(rows, n), numbers, sents, first_sent, sent_start, sent_end, sent_words, np.repeat(rows, sents))


def syllables(words: pa.Array) -> np.ndarray:
    """Of each word, as text.syllables()."""
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = data[offsets[0] : offsets[-1]]
    kept = (data >= 97) & (data <= 122)
    ends = _sums(kept)[offsets - offsets[0]]
    letters, size = data[kept], np.diff(ends)
    vowel = np.isin(letters, np.frombuffer(b"aeiouy", np.uint8))
    last = ends[1:][size > 0] - 1
    vowel[last[letters[last] == 101]] = False
    begins = vowel.copy()
    begins[1:] &= ~vowel[:-1]
    starts = ends[:-1][size > 0]
    begins[starts] = vowel[starts]
    groups = _within(_sums(begins), ends[:-1], ends[1:])
    return np.where(size > 0, np.maximum(1, groups), 0)


# MD5 of one block (RFC 1321), over arrays of messages.
_TURNS = [t for own in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in own * 4]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_BLOCK = 1 << 16


def _first_of_md5(message: list[np.ndarray | None]) -> np.ndarray:
    """The digests' first four bytes as big-endian numbers; message: its 16 words, None for those that are 0."""
    size = len(message[0])
    a, b, c, d = (np.full(size, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the last three steps don't reach the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        a += np.uint32(_SINES[i])
        if (m := message[_PLACES[i]]) is not None:
            a += m
        np.left_shift(a, np.uint32(_TURNS[i]), out=g), np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a), np.bitwise_or(a, g, out=a)
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def green_masks(before: pa.Array, after: pa.Array) -> np.ndarray:
    """Of pairs of words, bits: for which of the seeds the second is green, as features.green() has it."""
    seeds = [f"{s}\x1f".encode() for s in lexicon.GREEN_SEEDS]
    most = max(map(len, seeds))
    tails = pc.binary_join_element_wise(before, after, "g", "\x1f").cast(pa.large_binary())
    sizes, out, least = pc.binary_length(tails).to_numpy().astype(np.int64), np.zeros(len(tails), np.int32), -1
    for upto in (18, 34, 55 - most):
        rows = np.flatnonzero((sizes > least) & (sizes <= upto))
        least, n_words = upto, -(-(most + upto + 1) // 4)
        width = most + 4 * n_words
        for at in range(0, len(rows), _BLOCK):
            own = rows[at : at + _BLOCK]
            part, size = tails.take(pa.array(own)), sizes[own]
            flat, lines = np.zeros(len(own) * width, np.uint8), np.arange(len(own)) * width + most
            flat[np.arange(size.sum()) + np.repeat(lines - _sums(size)[:-1], size)] = np.frombuffer(part.buffers()[2], np.uint8)[: size.sum()]
            flat[lines + size] = 0x80
            laid, ready = flat.reshape(len(own), width), {}
            for k, seed in enumerate(seeds):
                p = len(seed)
                if p not in ready:
                    ready[p] = np.ascontiguousarray(np.ascontiguousarray(laid[:, most - p : most - p + 4 * n_words]).view("<u4").T)
                words = [*ready[p], *[None] * (16 - n_words)]
                words[14] = ((size + p) * 8).astype(np.uint32)
                number = int.from_bytes(seed, "little")
                for place in range(-(-p // 4)):
                    words[place] = words[place] | np.uint32(number >> 32 * place & 0xFFFFFFFF)
                out[own] |= ((_first_of_md5(words) >> 4) % 10_000 < 5_000).astype(np.int32) << k
    for row in np.flatnonzero(sizes > least).tolist():
        tail = tails[row].as_py()
        out[row] = sum((int.from_bytes(hashlib.md5(s + tail, usedforsecurity=False).digest()[:4], "big") >> 4) % 10_000 < 5_000 and 1 << k for k, s in enumerate(seeds))
    return out


_BOUND = r"(?<!\w)(?:%s)(?!\w)"
#: Patterns, and what a text must hold for their alternatives to match.
_STOCK = [(re.compile(_BOUND % p), [re.match("[a-z' ]+", x)[0] for x in re.sub(r"\|(?=[^(]*\))", "", p).split("|")]) for p in (lexicon.HEDGES, lexicon.STOCK_WORDS)]
_TEMPLATES = [*re.sub(r"\(\?:[^)]*\)", "", lexicon.HEDGES).split("|"), *lexicon.STOCK_WORDS.split("|"), *lexicon.STOCK_PHRASES, *lexicon.OPENERS]
#: A text with a stock phrase or a template has one of these inside a word, or inside a token that begins with a number that is no digit.
_HINTS = "|".join(sorted({max(re.findall("[a-z]+", p), key=lambda w: (w not in lexicon.FUNCTION_WORDS, len(w))) for p in _TEMPLATES}))


def _phrases(c: Cut) -> tuple[np.ndarray, np.ndarray]:
    """Stock phrases of each text, and sentences among its first eight and last three that begin like a template."""
    stock, openers = np.zeros(len(c.n), np.int64), np.zeros(len(c.n), np.int64)
    hint = pc.match_substring_regex(c.words, _HINTS).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero((np.bincount(c.doc, hint[c.ids], len(c.n)) > 0) | c.numbers).tolist():
        text = c.raws[k].lower()
        stock[k] = sum(len(p.findall(text)) for p, needs in _STOCK if any(x in text for x in needs)) + sum(p in text for p in lexicon.STOCK_PHRASES)
        if not any(o in text for o in lexicon.OPENERS):
            continue
        a, b = c.first_sent[k], c.first_sent[k + 1]
        for s in [*range(a, min(a + 8, b)), *range(max(a, b - 3), b)]:
            begin = c.sent_start[s] - c.chars[k]
            head = c.raws[k][begin : min(begin + 64, c.sent_end[s] - c.chars[k])].lower()
            openers[k] += any(head[:48].startswith(o) or o in head[:40] for o in lexicon.OPENERS)
    return stock, openers


def _sentences(c: Cut) -> dict[str, np.ndarray]:
    k, lens = c.sents, c.sent_words.astype(float)
    total = np.bincount(c.sent_doc, lens, len(k))
    mean = np.where(k > 0, _ratio(total, k), c.n)
    square = np.bincount(c.sent_doc, (lens - mean[c.sent_doc]) ** 2, len(k))
    std = np.where(k > 1, np.sqrt(square / np.maximum(1, k - 1)), 0.0)
    spread = std / np.where(mean > 0, mean, 1.0)
    # Neighbours' common words: a sentence's set, moved by one sentence, meets the next one's.
    of = np.repeat(np.arange(len(lens)), c.sent_words)
    sets, _ = _counted(of << c.bits | c.ids)
    sizes = np.bincount(sets >> c.bits, minlength=len(lens))
    common = np.bincount(_both(sets + (1 << c.bits), sets) >> c.bits, minlength=len(lens) + 1)[: len(lens)]
    earlier = np.append(0, sizes[:-1]) if len(sizes) else sizes
    near = np.where((sizes > 0) & (earlier > 0), common / np.maximum(1, sizes + earlier - common), 0.0)
    near[c.first_sent[:-1][k > 0]] = 0.0
    at = _sums(c.sent_words)[:-1][c.sent_words > 0]
    starts, _ = _counted(c.sent_doc[c.sent_words > 0] << c.bits | c.ids[at])
    return {
        "mean_sl": mean, "std_sl": std, "burstiness": np.where((k < 2) | (mean <= 0), 0.0, spread),
        "length_uniformity": np.where((k < 3) | (mean <= 0), 0.0, 1 - 1 / (1 + np.exp(-8.0 * (spread - 0.38)))),
        "adjacent_similarity": _ratio(np.bincount(c.sent_doc, near, len(k)), k - 1),
        "start_diversity": _ratio(np.bincount(starts >> c.bits, minlength=len(k)), np.bincount(c.sent_doc[c.sent_words > 0], minlength=len(k))),
    }


def _runs(c: Cut) -> dict[str, np.ndarray]:
    """What is counted of words, runs of two and runs of three: by one sort of each word with the two behind it."""
    b, n, rows, none = c.bits, c.n, len(c.n), len(c.words)
    left = np.repeat(c.first_word[1:], n) - np.arange(len(c.ids))
    second = np.where(left > 1, np.append(c.ids[1:], none)[: len(c.ids)], none)
    third = np.where(left > 2, np.append(c.ids[2:], [none, none])[: len(c.ids)], none)
    pairs = (c.doc << b | c.ids) << b | second
    if rows.bit_length() + 3 * b < 63:
        runs = np.sort(pairs << b | third)
        pairs = runs >> b
    else:
        known, place = np.unique(pairs, return_inverse=True)
        runs = np.sort(place << b | third)
        pairs = known[runs >> b]
    at = _firsts(pairs >> b)
    of, r = pairs[at] >> 2 * b, np.diff(at, append=len(pairs))
    v, v1 = np.bincount(of, minlength=rows), np.bincount(of[r == 1], minlength=rows)
    squares = np.bincount(of, r * r, rows)
    at, low = _firsts(pairs), (1 << b) - 1
    at, r = at[own := pairs[at] & low != none], np.diff(at, append=len(pairs))[own]
    of, share = pairs[at] >> 2 * b, r / np.maximum(1, n - 1)[pairs[at] >> 2 * b]
    entropy = -np.bincount(of, share * np.log(share + 1e-12), rows)
    at = _firsts(runs)
    at, r = at[own := runs[at] & low != none], np.diff(at, append=len(runs))[own]
    triples = np.bincount(pairs[at] >> 2 * b, minlength=rows)
    steady = often = np.zeros(rows)
    if len(at):
        group = _firsts(pairs[at])
        total, top, of = np.add.reduceat(r, group), np.maximum.reduceat(r, group), pairs[at][group] >> 2 * b
        again = total > 1
        often, steady = np.bincount(of[again], minlength=rows), np.bincount(of[again], (top / total)[again], rows)
    x, k = n.astype(float), np.maximum(0, n - 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        honores = np.where((n < 8) | (v1 == v), 0.0, 100 * np.log(x) / (1 - v1 / v))
        yules = np.where(n < 8, 0.0, 1e4 * (squares - n) / (x * x))
    context = np.where(n < 24, 0.0, np.where(often < 4, 0.15, _clamp((steady / np.maximum(1, often) - 0.35) / 0.5)))
    return {
        "ttr": _ratio(v, x), "hapax": _ratio(v1, x), "yules_k": yules, "honores_r": honores, "bigram_entropy": np.where(n > 1, entropy, 0.0),
        "ngram_reuse": np.where(k < 12, 0.0, _clamp((k - triples) / np.maximum(1, k) * 4.0)), "context_consistency": context,
    }


def _windows(n: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text.window_starts() of the texts with a window's words at least: each window's text, start and words, and where texts' first ones are."""
    rows = np.flatnonzero(n >= window)
    many = -(-(n[rows] - window) // stride) + 1
    first = _sums(many)[:-1]
    start = (np.arange(many.sum()) - np.repeat(first, many)) * stride
    of = np.repeat(rows, many)
    return of, start, np.minimum(window, n[of] - start), first


@lru_cache
def _three() -> np.ndarray:
    """By mask, the bits of three seeds, each in 21 bits of its own."""
    masks = np.arange(1 << len(lexicon.GREEN_SEEDS))
    return np.array([sum((masks >> at + i & 1) << 21 * i for i in range(3)) for at in range(0, len(lexicon.GREEN_SEEDS), 3)])


def _watermark(c: Cut, rare: np.ndarray) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The heuristics over green words, and hot_spans; rare: whether a word is, by id."""
    n, seeds, rows = c.n, len(lexicon.GREEN_SEEDS), np.arange(len(c.n))
    inner = np.ones(len(c.ids), bool)
    inner[c.first_word[:-1][n > 0]] = False
    second = np.flatnonzero(inner)
    pairs = pa.array(c.ids[second - 1] << c.bits | c.ids[second]).dictionary_encode()
    own = pairs.dictionary.to_numpy()
    masks = green_masks(c.words.take(pa.array(own >> c.bits)), c.words.take(pa.array(own & (1 << c.bits) - 1)))[pairs.indices.to_numpy()]
    count = np.maximum(0, n - 1)
    begin = _sums(count)
    # Three seeds' hits are summed in one number, 21 bits each, where no text has more words than these hold.
    sums = _sums(masks & 1)
    if count.max(initial=0) < 1 << 21:
        packed = [_within(_sums(t[masks]), begin[:-1], begin[1:]) for t in _three()]
        hits = np.array([packed[s // 3] >> 21 * (s % 3) & (1 << 21) - 1 for s in range(seeds)])
    else:
        hits = np.array([_within(_sums(masks >> s & 1), begin[:-1], begin[1:]) for s in range(seeds)])
    k = np.maximum(1, n - 1)
    t, root = 2 * hits - k, np.sqrt(k.astype(float))
    out = {
        "max_z": t.max(0) / root, "mean_abs_z": np.abs(t).sum(0) / (seeds * root),
        "z_std": np.sqrt((seeds * (t * t).sum(0) - t.sum(0) ** 2) / (seeds * (seeds - 1) * k).astype(float)),
    }
    of, start, m, first = _windows(n, 48, 24)
    spike = np.zeros(len(n))
    if len(of):
        rates = _within(sums, begin[of] + start, begin[of] + start + m - 1) / np.maximum(1, m - 1)
        many = np.diff(first, append=len(of))
        mean = np.add.reduceat(rates, first) / many
        away = np.abs(rates - np.repeat(mean, many))
        std = np.where(many > 1, np.sqrt(np.add.reduceat(away * away, first) / np.maximum(1, many - 1)), 0.0)
        peak = np.maximum.reduceat(away, first) / np.where(std > 1e-9, std, 1.0)
        spike[of[first]] = np.where((many < 2) | (std <= 1e-9), 0.0, _clamp((peak - 1.1) / 3.0))
    out["window_spike"] = spike
    odd, g = rare[c.ids[second]], masks >> 1 & 1
    within = lambda x: _within(_sums(x), begin[:-1], begin[1:])
    rn, rg, all_g = within(odd), within(odd * g), within(g)
    cn, cg = count - rn, all_g - rg
    few = (n < 24) | (rn < 6) | (cn < 6)
    out["rare_alignment"] = np.where(few, 0.0, _clamp((rg / np.maximum(1, rn) - cg / np.maximum(1, cn)) / 0.25))
    of, start, m, _ = _windows(n, 80, 40)
    k = np.maximum(1, m - 1).astype(float)
    z = (_within(sums, begin[of] + start, begin[of] + start + m - 1) / k - 0.5) / np.sqrt(0.25 / k)
    hot = np.flatnonzero(z >= 1.6)
    place = np.arange(len(hot)) - np.searchsorted(of[hot], of[hot])
    hot = hot[place < 12]
    spans = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in ((start[hot], pa.int32()), ((start + m)[hot], pa.int32()), (_clamp((z[hot] - 1) / 4), pa.float64()))], names=["start", "end", "score"])
    return out, pa.ListArray.from_arrays(pa.array(np.searchsorted(of[hot], np.append(rows, len(n))), pa.int32()), spans)


FEATURES = (
    "perplexity", "burstiness", "ttr", "hapax", "phrase_density", "opener_score", "length_uniformity", "ngram_reuse", "punctuation_uniformity",
    "function_word_ratio", "yules_k", "honores_r", "mean_sl", "std_sl", "function_word_fit", "contraction_ratio", "start_diversity",
    "adjacent_similarity", "bigram_entropy", "comma_ratio", "avg_syllables", "max_z", "mean_abs_z", "z_std", "context_consistency",
    "window_spike", "rare_alignment",
)
_MARKS = ",.;:!?—-"


def features(texts: list[str], ranks: dict[str, int], watermark: bool = True) -> pa.StructArray:
    """n, FEATURES and hot_spans of each text; without watermark, its heuristics are 0."""
    c = cut(texts)
    n, rows, b = c.n, len(texts), c.bits
    x = n.astype(float)
    over = np.maximum(1, n)
    stock, openers = _phrases(c)
    out = {"phrase_density": _clamp(stock / np.maximum(1.0, over / 80.0) / 3.0 * 1.4)}
    out["opener_score"] = np.where(c.sents == 0, 0.0, _clamp(openers / np.maximum(2.0, (np.minimum(c.sents, 8) + np.minimum(c.sents, 3)) / 3.0)))
    at = np.flatnonzero(c.kinds == VISIBLE)
    mark = pc.fill_null(pc.index_in(pa.array(c.codes[at]).cast(pa.uint32()), pa.array([*map(ord, _MARKS)], pa.uint32())), -1).to_numpy(zero_copy_only=False)
    at, mark = at[mark >= 0], mark[mark >= 0]
    marks = np.bincount(mark * rows + np.searchsorted(c.chars, at, "right") - 1, minlength=len(_MARKS) * rows).reshape(len(_MARKS), rows)
    total = marks.sum(0)
    share = marks / np.maximum(1, total)
    even = -(share * np.log(share + 1e-12)).sum(0) / np.log(np.maximum(2, (marks > 0).sum(0)))
    out["punctuation_uniformity"] = np.where(total < 8, 0.3, 1 - 1 / (1 + np.exp(-5.0 * (even - 0.55))))
    out["comma_ratio"] = marks[0] / over
    # Values of words by id, then of texts.
    special = [*lexicon.EXPECTED_SHARE, *lexicon.RARE_FUNCTION_WORDS]
    place = lambda listed: pc.fill_null(pc.index_in(c.words, pa.array(listed, pa.string())), -1).to_numpy(zero_copy_only=False)
    rank = np.append([*ranks.values()], -1).astype(np.int64)[place([*ranks])]
    listed = np.log((np.maximum(rank, 0) + 2) * math.log(M.VOCABULARY + 1))
    surprisal = np.where(rank < 0, math.log(M.VOCABULARY * math.log(M.VOCABULARY)), listed)
    of = lambda value: np.bincount(c.doc, value[c.ids], rows)
    out["perplexity"] = np.where(n > 0, np.minimum(np.exp(np.minimum(of(surprisal) / over, 20.0)), 1e6), 0.0)
    out["function_word_ratio"] = _ratio(of((place([*dict.fromkeys(lexicon.FUNCTION_WORDS)]) >= 0).astype(float)), x)
    out["contraction_ratio"] = of(pc.match_substring(c.words, "'").to_numpy(zero_copy_only=False).astype(float)) / over
    out["avg_syllables"] = of(syllables(c.words)) / over
    index = place(special)[c.ids]
    seen = np.bincount((c.doc * len(special) + index)[index >= 0], minlength=rows * len(special)).reshape(rows, -1)
    expected = np.array([*lexicon.EXPECTED_SHARE.values()])
    close = (1 - np.minimum(1.0, np.abs(seen[:, : len(expected)] / over[:, None] - expected) / (expected + 1e-6))).sum(1)
    missing = (seen[:, len(expected) :] == 0).sum(1)
    out["function_word_fit"] = np.where(n > 0, _clamp(0.75 * close / len(expected) + 0.25 * missing / len(lexicon.RARE_FUNCTION_WORDS)), 0.0)
    out |= _sentences(c) | _runs(c)
    if watermark:
        more, spans = _watermark(c, (rank < 0) | (rank > lexicon.COMMON_RANK))
        out |= more
    else:
        spans = pa.array([[]] * rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
    none = np.zeros(rows)
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), *[pa.array(out.get(f, none), pa.float64()) for f in FEATURES], spans], names=["n", *FEATURES, "hot_spans"])


_KIND = "struct<n:int," + ",".join(f"{f}:double" for f in FEATURES) + ",hot_spans:array<struct<start:int,end:int,score:double>>>"


def measured(docs: DataFrame, ranks: dict[str, int], text: str = "text", watermark: bool = True) -> DataFrame:
    """docs with n (words), FEATURES and hot_spans of a text column."""

    @F.arrow_udf(_KIND)
    def of(texts: pa.Array) -> pa.Array:
        parts, rows = [], []
        for own, (piece,) in batches(texts):
            parts.append(features(piece, ranks, watermark))
            rows.append(own)
        return _in_order(parts, rows) if parts else features([], ranks, watermark)

    return docs.drop("n", *FEATURES, "hot_spans").withColumn("__f", of(F.col(text))).select("*", "__f.*").drop("__f")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """tok, n: the words of a text column, counted piece by piece; a word has several rows."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, (piece,) in batches(batch.column(0)):
                c = cut(piece)
                yield pa.RecordBatch.from_arrays([c.words, pa.array(np.bincount(c.ids, minlength=len(c.words)), pa.int64())], names=["tok", "n"])

    return docs.select(text).mapInArrow(count, "tok string, n long")


def _trigrams(texts: list[str]) -> tuple[np.ndarray, int]:
    """Runs of three characters of the lower-cased texts with single blanks, each above a bit for the second text of a pair and below the
    pair's number; and the bits below the number. A shorter text is its own run."""
    if not (whole := "".join(texts)).isascii() and any(x in whole for x in CONTEXT):
        texts = [t.lower() for t in texts]
        whole = "".join(texts)
    codes, ends = _codes(whole), _sums(np.array([*map(len, texts)], np.int64))
    used = np.zeros(0x110001, bool)
    used[codes] = True
    used = np.flatnonzero(used)
    # Each character's number: that of its lower case, or the blank's.
    values = np.where(classes(used) == SPACE, 32, _lower[used])
    alphabet = np.unique(np.append(values, 32))
    number = np.zeros(0x110000, np.uint32)
    number[used] = np.searchsorted(alphabet, values)
    x = number[: used[-1] + 1 if len(used) else 0][codes]
    space = x == np.searchsorted(alphabet, 32)
    again = np.zeros(len(x), bool)
    again[1:] = space[1:] & space[:-1]
    again[ends[:-1][np.diff(ends) > 0]] = False
    x, ends = x[~again], ends - _sums(again)[ends]
    del codes, whole, space, again
    size = np.diff(ends)
    lack = np.where((size > 0) & (size < 3), 3 - size, 0)
    if lack.any():
        x = np.insert(x, np.repeat(ends[1:], lack), np.uint32(len(alphabet)))
        ends = ends + _sums(lack)
        size = np.diff(ends)
    bits, pairs = len(alphabet).bit_length(), (len(texts) // 2).bit_length()
    kind = np.uint32 if pairs + 3 * bits + 1 <= 32 else np.int64
    if len(x) < 3:
        return x[:0].astype(kind), 3 * bits + 1
    x, shift = x.astype(kind, copy=False), kind(bits)
    inner = np.ones(len(x), bool)
    inner[np.concatenate([ends[1:][size > 0] - 1, ends[1:][size > 0] - 2])] = False
    inner = inner[:-2]
    above, first = 2 * bits, x[:-2] << shift | x[1:-1]
    if pairs + 3 * bits + 1 > 63:  # too many unlike characters: the runs of two that occur are numbered
        known, first = np.unique(first, return_inverse=True)
        above = len(known).bit_length()
    text = np.arange(len(size), dtype=kind)
    runs = np.repeat(text >> kind(1) << kind(above), size)[:-2]
    runs |= first
    del first
    runs <<= shift
    runs |= x[2:]
    runs <<= kind(1)
    runs |= np.repeat(text & kind(1), size)[:-2]
    return runs[inner], above + bits + 1


COUNTS = ("dot", "aa", "bb", "common", "na", "nb", "inter", "either")


def _overlap(keys: np.ndarray, bits: int, pairs: int) -> dict[str, np.ndarray]:
    """COUNTS of pairs of texts, by items with the pair's number above `bits` and the text's in the last bit."""
    keys, count = _counted(keys)
    text = (keys >> keys.dtype.type(bits)).astype(np.int64) << 1 | (keys & keys.dtype.type(1)).astype(np.int64)
    both = np.flatnonzero(keys[1:] ^ keys[:-1] == 1) if len(keys) else np.zeros(0, np.int64)
    both = both[keys[both] & keys.dtype.type(1) == 0]  # an item's two texts are neighbours
    p, q, of = count[both], count[both + 1], text[both] >> 1
    by = lambda value: np.bincount(text, value, 2 * pairs)
    square, items, unlike, inter = by(count * count), by(count), np.bincount(text, minlength=2 * pairs), np.bincount(of, minlength=pairs)
    out = [np.bincount(of, p * q, pairs), square[::2], square[1::2], np.bincount(of, np.minimum(p, q), pairs), items[::2], items[1::2], inter, unlike[::2] + unlike[1::2] - inter]
    return {k: v.astype(np.int64) for k, v in zip(COUNTS, out, strict=True)}


def compared(first: list[str], second: list[str]) -> dict[str, np.ndarray]:
    """Of pairs of texts: COUNTS of their words; of their runs of three characters, g_dot, g_aa, g_bb; and their sentences and syllables."""
    texts = [t for pair in zip(first, second, strict=True) for t in pair]
    own = _overlap(*_trigrams(texts), len(first))  # before the words, which aren't in hand then
    c = cut(texts)
    out = _overlap(((c.doc >> 1) << c.bits | c.ids) << 1 | c.doc & 1, c.bits + 1, len(first))
    out |= {f"g_{k}": own[k] for k in ("dot", "aa", "bb")}
    syll = np.bincount(c.doc, syllables(c.words)[c.ids], len(texts)).astype(np.int64)
    return out | {"sents_a": c.sents[::2], "sents_b": c.sents[1::2], "syll_a": syll[::2], "syll_b": syll[1::2]}


_COMPARED = (*COUNTS, "g_dot", "g_aa", "g_bb", "sents_a", "sents_b", "syll_a", "syll_b")


@F.arrow_udf(StructType([StructField(c, LongType()) for c in _COMPARED]))
def comparison(first: pa.Array, second: pa.Array) -> pa.Array:
    """compared() of two text columns."""
    parts, rows = [], []
    for own, piece in batches(first, second):
        found = compared(*piece)
        parts.append(pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in _COMPARED], names=[*_COMPARED]))
        rows.append(own)
    return _in_order(parts, rows) if parts else pa.array([], pa.struct([(c, pa.int64()) for c in _COMPARED]))
