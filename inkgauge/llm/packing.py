"""Packing by power-of-two decomposition.

Each document's token ids, with an end id, are cut into pieces whose lengths are powers of two: as many of the
longest as fit, then one for each binary digit of what remains. Equal lengths form a bucket; every piece is a
sequence of its own, so no sequence crosses documents and none is padded. Cutting is local to a row: nothing is
shuffled, and a document's pieces leave the worker as they are cut.

Ids come from a `tokenizers` file. For byte-level BPE files without normalizer the same vocabulary also drives a
faster merge engine, which takes whole texts; only long ones are split, before a
blank that a non-blank follows, where this pre-tokenizer splits too, and around the file's added tokens, which keep their own
ids as `tokenizers` gives them. Other files are encoded by `tokenizers` alone.

Defined results: null text is empty and gives the end id alone (one piece of length 1); repeated rows and null ids
are packed like any other; an empty table gives no rows;
extra columns aren't kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_of

#: Characters that are encoded at once.
SLICE_CHARS = 1 << 20
#: The splitting rule of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Callable[[str], bytes]] = {}


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the rest as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merge_engine(tok) -> Callable[[str], list[int]] | None:
    """An engine with tok's vocabulary, if tok is a plain byte-level BPE whose ids follow its merges."""
    import tiktoken

    spec = json.loads(tok.to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    byte, special = _byte_of_char(), {t["content"] for t in spec["added_tokens"]}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or any(c not in byte for k in vocab for c in k):
        return None
    ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def plain_engine(path: str) -> Callable[[str], list[int]]:
    """text -> its ids, with the strings of added tokens as plain text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return _merge_engine(tok) or (lambda text: tok.encode(text, add_special_tokens=False).ids)


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as unsigned little-endian 32-bit numbers."""
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    engine = _merge_engine(tok)
    added = {t["content"]: t for t in json.loads(tok.to_str())["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and not t["special"] for t in added.values()):
        engine = None
    packed = lambda ids: np.asarray(array("I", ids), "<u4").tobytes()  # noqa: E731  (numpy alone takes twice as long over a list)
    if engine is None:
        _encoders[path] = lambda text: packed(tok.encode(text, add_special_tokens=False).ids)
        return _encoders[path]

    def encode_plain(text: str) -> bytes:
        if len(text) <= SLICE_CHARS:
            return packed(engine(text))
        out, at = [], 0
        safe = re.compile(r" (?=\S)")
        while at < len(text):
            m = safe.search(text, at + SLICE_CHARS)
            end = m.start() if m else len(text)
            out.append(packed(engine(text[at:end])))
            at = end
        return b"".join(out)

    apart = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def encode(text: str) -> bytes:
        if not any(t in text for t in added):
            return encode_plain(text)
        out, at = [], 0
        for m in apart.finditer(text):
            out += [encode_plain(text[at : m.start()]) if m.start() > at else b"", packed([added[m[0]]["id"]])]
            at = m.end()
        return b"".join([*out, encode_plain(text[at:]) if at < len(text) else b""])

    _encoders[path] = encode
    return encode


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as powers of two, falling, none over longest (a power of two)."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """A row for each sequence: doc_id, start, length (its bucket), ids, doc_tokens, sequence_id, offset.

    ids are unsigned little-endian 32-bit numbers; start counts the document's ids before the piece.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = encode(text.as_py()) + end, doc.as_py()
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n))
                    start += length
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    cut_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long"
    )
    return cut_rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as one folder for each length, so that a batch takes equal lengths from one folder."""
    packed.write.partitionBy("length").parquet(path)
