"""The exact keyed hash and generator: BLAKE2b of 64 bits, and the Mersenne Twister that it seeds, by Arrow batches.

Neither is built into Spark. functions.maths has the MD5 form, which stays in the JVM and which SQL engines can follow.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash64(parts: list[str], seed: int = 0) -> int:
    """The hash of parts, each behind U+001F, and of a signed 64-bit seed, as an unsigned number."""
    h = hashlib.blake2b(seed.to_bytes(8, "little", signed=True), digest_size=8)
    for part in parts:
        h.update(b"\x1f" + part.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest(), "little")


def blake_hash(parts: list[Column | str], seed: int = 0) -> Column:
    """hash64 as decimal(20,0); null parts are empty."""
    if not -(1 << 63) <= seed < 1 << 63:
        raise ValueError("the seed must fit into 64 bits")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([str(hash64(list(p), seed)) for p in batch])

    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return run(F.array(*cols)).cast("decimal(20,0)")


def uniforms(hashed: Column, n: int) -> Column:
    """The first n numbers in [0, 1) of the Twister that starts from each hash; null for null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rng = random.Random()
        for batch in batches:
            out = []
            for h in batch:
                if h is None:
                    out.append(None)
                    continue
                rng.seed(int(h))
                out.append([rng.random() for _ in range(n)])
            yield pd.Series(out, dtype=object)

    return run(hashed.cast("string"))


def choices(hashed: Column, sizes: Column) -> Column:
    """For each of an array of sizes, in order, the place that the same generator's choice among so many gives; -1 where there is none."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rng = random.Random()
        for batch in batches:
            out = []
            for h, ns in zip(*batch, strict=True):
                if h is None or ns is None:
                    out.append(None)
                    continue
                rng.seed(int(h))
                out.append([rng.choice(range(int(n))) if n > 0 else -1 for n in ns])
            yield pd.Series(out, dtype=object)

    return run(hashed.cast("string"), sizes)
