"""Importance resampling towards a target distribution.

Words and runs of words are hashed into buckets. The corpus's and the target's counts of each bucket give the bucket's gain, the log of
how much likelier the target makes it, in whole thousandths. Tasks count into one array of buckets each and the arrays are
summed by bucket; the array of gains, of a fixed size, goes back to them and scores each document by lookups. A Gumbel variate of the document's
id is added, so that the k highest scores are a draw without replacement in proportion to the importance.

The k-th highest (score, doc_id) is found exactly by radix selection: the key's digits, from the most significant on, are
counted among the rows that agree with the digits found so far, and only those counts (one for each digit) reach the driver. Only
the rows from that key on are dealt by range and ranked.

Defined results: null and empty texts have no features and weight 0, and like all documents under the least number of words take no part in the
draw; rows with one id and text have one score, and where the k-th key lies among them as many of them as fit are drawn; a missing id is hashed
as empty and loses ties; empty tables give no rows, an empty target only its smoothing; texts of any length are counted whole;
extra columns aren't kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import global_rank, written

#: Bytes of UTF-8 as words hold them: A-Z as a-z, every other ASCII byte but letters and digits as a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bits of a digit of the selection; a digit has at most so many counts.
DIGIT_BITS = 16


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to `longest` words."""
    parts = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
    for n in range(2, min(longest, len(words)) + 1):
        runs = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
        parts.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(words) - n + 1))
    return np.concatenate(parts) % buckets


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task gives its array once; the driver gets one sum a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                counts += np.bincount(buckets_of(words_of(t.as_py()), longest, buckets), minlength=buckets)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = words_of(t.as_py())
                found = buckets_of(words, longest, len(gain))
                rows.append((len(words), len(found), int(gain[found].sum())))
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int):
    """A column: floor(-1000 ln(-ln u)) for the u in (0, 1) that the seed and doc_id give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, score: str, tie: str, k: int) -> tuple[int, int] | None:
    """The k-th (from 1) of rows in falling order of score and, within it, rising tie (null last); None beyond the last.

    Both are long. As unsigned numbers with the score turned round they are read in digits of DIGIT_BITS; a job counts one digit of the rows
    that agree so far, and the search ends early where the keys that agree are one.
    """
    # Smaller comes first: ~score, and tie, with their sign bits turned, as two halves of a number of 128 bits and a bit for null.
    halves = [F.col(score).bitwiseXOR(-1), F.when(F.col(tie).isNull(), 0x7FFFFFFFFFFFFFFF).otherwise(F.col(tie))]
    left, found = k, []
    for half in halves:
        ends = rows.agg(F.min(half).alias("low"), F.max(half).alias("high"), F.count("*").alias("n")).first()
        if ends["low"] is None or ends["n"] < left:
            return None
        low, high = ends["low"], ends["high"]
        # Digits of the distance from the smallest, which needs no more of them than the range does.
        span, base = (high - low).bit_length(), low
        for shift in range((span - 1) // DIGIT_BITS * DIGIT_BITS if span else -DIGIT_BITS, -1, -DIGIT_BITS):
            at_least = half >= F.lit(base)
            below = F.lit(True) if base + (1 << (shift + DIGIT_BITS)) > high else half < F.lit(base + (1 << (shift + DIGIT_BITS)))
            # The distance may need 64 bits unsigned: in a session under ANSI rules it is taken by adding with two's complement in decimals.
            digit = F.floor((half.cast("decimal(20,0)") - F.lit(base).cast("decimal(20,0)")) / F.lit(1 << shift).cast("decimal(20,0)")).cast("int")
            counts = sorted(rows.where(at_least & below).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
            for r in counts:
                if r["n"] >= left:
                    base += r["d"] << shift
                    break
                left -= r["n"]
        found.append(base)
        rows = rows.where(half == F.lit(base))
    return ~found[0], found[1]


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1, of those drawn; else null) of each row of docs."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    scored = weighed(docs, gain, id_col=id_col, text_col=text_col, longest=longest).withColumn("score", F.col("weight") + gumbel(seed))
    scored = written(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    key = kth_key(able, "score", "doc_id", k) if k else None
    if key is None:
        return scored.select(*out, none)
    score, doc = (F.lit(x) for x in key)
    tie = F.coalesce("doc_id", F.lit(0x7FFFFFFFFFFFFFFF))
    drawn = F.coalesce((F.col("n_words") >= least_words) & ((F.col("score") > score) | ((F.col("score") == score) & (tie <= doc))), F.lit(False))
    # Rows alike in score and id are told apart by their place alone, so that none of them is a hot key of the sort.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("__row")]
    ranked = global_rank(scored.where(drawn).select(*out, F.monotonically_increasing_id().alias("__row")), order, "drawn")
    place = F.col("rank") + 1
    return ranked.select(*out, F.when(place <= k, place).alias("rank")).unionByName(scored.where(~drawn).select(*out, none))
