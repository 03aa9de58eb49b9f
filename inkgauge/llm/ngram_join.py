"""N-gram Jaccard self-join by PartEnum signatures, and the components of its links.

A document's set holds 64-bit hashes of its distinct n-word shingles. Sets are laid into size bands so that two sets
within the threshold are in the same or in neighbouring bands; for each such pair of bands a bound k on the
symmetric difference holds. The feature domain is dealt into groups and each group into three parts. There are g = k/2 + 1 + x
groups, so in some of them two linked sets differ in one feature at most, and then agree in two of the three parts: a
set's signatures are, for each group, the three pairs of its parts. A group without differences shares all three, one
with one difference shares one, so sets that differ in D features share 3g - 2D signatures at least, and 2g - D where D
exceeds g. Each set leaves out its d weakest signatures (fewest features first, an order all sets share), those of empty
parts among them, which lowers this number, `need`, by d; D follows from the sizes.

Equal sets of whatever size (those of up to three shingles have no signatures) are linked by a hash of the whole set, which comes from the same pass.
Documents with fewer than `need` signatures that any other has are out. For the others the sets themselves are laid down, and
those stay whose features occur often enough outside them, counted by narrow ranges of size: of two linked sets of n and s features
each holds p (n + s) / (100 + p) that the other has. Each of these is compared with two centres, documents that it
shares most signatures with; links give components. What may still be linked across components is found exactly: pairs
with a centre in common differ from it in different ways, so they meet by a common feature outside the centre (or by size, where
what they share with it is enough), and pairs without one must share `need` signatures. So a group of near copies that aren't
linked never makes all its pairs. All candidates are verified on whole sets.

What a task holds is one batch of texts; signatures are sorted and grouped by Spark, which spills. Links and
components stay tables: components come by rounds of large-star and small-star. Tables of a row or two for each document are
broadcast up to 100,000 rows only: their files are small enough for Spark to send millions of rows through the driver.

Copies of a text are found first, by its SHA-256: the smallest id stands for all of them.

Defined results: null or empty text, and text of white space alone, is an empty set, linked with nothing; with fewer
words than n the whole sequence is the one shingle; rows with one id are one document, linked if any of its texts is;
rows without an id keep their set's size and get a null component; an empty table gives no rows; extra columns aren't kept.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, discard, join_small, merged_if_large, text_of, written

SLICE_BYTES = 1 << 20
PARTS = 3
_rng = np.random.default_rng(20240229)
#: Random odd multipliers by byte, place in the word, and place in the shingle.
BYTE = _rng.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
PLACE = _rng.integers(0, 1 << 64, 1024, np.uint64) | np.uint64(1)
TURN = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z are lower-cased
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FULL = ~SPACE
LETTER = np.where(SPACE, np.uint64(0), BYTE)  # blanks add nothing to a word's sum
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= M1
    h ^= h >> np.uint64(29)
    h *= M2
    h ^= h >> np.uint64(32)
    return h


def _words_of(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    full = np.zeros(len(b) + 2, bool)
    full[1:-1] = FULL[b]
    edges = np.flatnonzero(full[1:] != full[:-1])
    first, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    # Each word with the blanks behind it.
    place = np.arange(first[0], len(b)) - np.repeat(first, np.diff(first, append=len(b)))
    value = LETTER[b[first[0] :]] * PLACE[place & 1023]
    if lengths.max() > 1024:
        value *= (2 * (place >> 10) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, first - first[0]) + lengths.astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, in order."""
    data = text.encode()
    if len(data) <= SLICE_BYTES:
        return _words_of(data)
    out, at = [], 0
    while at < len(data):
        end = at + SLICE_BYTES
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        out.append(_words_of(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct hashes of the text's n-word shingles, rising."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    m = min(n, len(w))
    h = np.zeros(len(w) - m + 1, np.uint64)
    for i in range(m):
        h += w[i : len(w) - m + 1 + i] * TURN[i % 64]
    return _distinct(mix(h + np.uint64(m)))


def _distinct(h: np.ndarray) -> np.ndarray:
    """The distinct numbers of h (one at least), rising."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, each of distinct numbers, are within the threshold."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


@functools.cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest size of each band, and the bound k for sets of a band and the next."""
    highs, high = [], 0
    while high < 1 << 40:
        high = max(high + 1, 100 * (high + 1) // percent)
        highs.append(high)
    h = np.array(highs, np.int64)
    # Sizes s and t within the threshold differ in at most (s + t) (100 - p) / (100 + p) features, and t <= 100 s / p.
    return h, (h + 100 * h // percent) * (100 - percent) // (100 + percent)


def spare(k: int) -> tuple[int, int]:
    """x and d for a bound k: more groups than half of it, and signatures that are left out."""
    return 1 + round(0.12 * k), 1 + round(0.03 * k)


def shapes(percent: int) -> list[tuple[int, int, int]]:
    """For each pair of bands with signatures: its number, its groups, and the signatures that are left out."""
    return [(i, k // 2 + 1 + x, d) for i, k in enumerate(bands(percent)[1].tolist()) if k for x, d in [spare(k)]]


def need(differ: str) -> str:
    """SQL: how many signatures sets share that differ in so many features, by the columns groups and d."""
    return f"(if({differ} <= groups, 3 * groups - 2 * ({differ}), greatest(0, 2 * groups - ({differ}))) - d)"


@functools.cache
def _layout(percent: int, band: int) -> tuple[int, int, np.uint64, np.ndarray]:
    """Groups, signatures that are left out, the turn of the features' hashes, and the cells' marks; no groups without signatures.

    Bands grow by a quarter or so, so all that are kept take a few times the room of the largest.
    """
    k = int(bands(percent)[1][band])
    x, d = spare(k)
    groups = k // 2 + 1 + x if k else 0
    turn = mix(np.array([band], np.int64).view(np.uint64) + M2)
    return groups, d, turn[0], mix(np.arange(groups * PARTS, dtype=np.uint64) * TURN[11] + turn)


def signatures(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """The set's signatures (of 48 bits; unlike ones that are equal only cost a comparison) by pair of bands."""
    own = int(np.searchsorted(bands(percent)[0], len(s)))
    out = []
    for band in (own - 1, own):
        if band < 0:
            continue
        groups, d, turn, marks = _layout(percent, band)
        if not groups:
            continue
        f = np.sort(mix(s + turn))  # cells rise with it
        cell = ((f >> np.uint64(32)) * np.uint64(groups * PARTS)) >> np.uint64(32)
        count = np.bincount(cell.view(np.int64), minlength=groups * PARTS)
        sums = np.zeros(len(f) + 1, np.uint64)
        np.cumsum(mix(f + M1), out=sums[1:])
        sums = sums[np.concatenate([[0], np.cumsum(count)])]
        # For each part, the signature of the others.
        content, count = (sums[1:] - sums[:-1]).reshape(groups, PARTS), count.reshape(groups, PARTS)
        content = sum(content[:, i] for i in range(PARTS))[:, None] - content
        count = sum(count[:, i] for i in range(PARTS))[:, None] - count
        sig = mix(content.reshape(-1) + marks) >> np.uint64(16)
        # The weakest go: those of the fewest features (beyond 65,535 all alike), then the smallest.
        order = np.minimum(count.reshape(-1), 65535).astype(np.uint64) << np.uint64(48) | sig
        out.append((band, (np.partition(order, d)[d:] & np.uint64((1 << 48) - 1)).view(np.int64)))
    return out


#: The bit of sig that marks a set's hash.
WHOLE = 1 << 62


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """62 and 23 bits that equal sets (of numbers that are hashes already) have in common."""
    a, b = mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), (s * (s | np.uint64(1))).sum(dtype=np.uint64)], np.uint64)).tolist()
    return a & (WHOLE - 1), b & ((1 << 23) - 1)


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """For each signature of each document (doc_id, text, name) a row sig, doc_id, kn: its pair of bands and the set's size.

    Beside them one row for each text: its name with the highest bit set as sig (signatures have 48 bits), and the size alone as kn; and one
    for each set: WHOLE and its hash as sig, the rest of the hash and the size as kn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            counts = [len(x) for x in sigs]
            cols = [np.concatenate(sigs), pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts))), np.repeat(keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sig", "doc_id", "kn"])

        sigs, ids, keys, held = [], [], [], 0
        for batch in batches:
            for doc, t, name in zip(*batch.columns, strict=True):
                s, doc = shingles(t.as_py(), n), doc.as_py()
                found = []
                if len(s) and doc is not None:
                    whole, rest = set_hash(s)
                    found = [(rest, np.array([WHOLE | whole])), *signatures(s, percent)]
                for key, part in [(0, np.array([name.as_py() | -1 << 63])), *found]:
                    sigs.append(part)
                    ids.append(doc)
                    keys.append(key << 40 | len(s))
                    held += len(part)
                if held > 200_000:
                    yield made()
                    sigs, ids, keys, held = [], [], [], 0
        if sigs:
            yield made()

    return docs.mapInArrow(run, "sig long, doc_id long, kn long")  # key and n in one number: less to shuffle


def _met(signed: DataFrame) -> DataFrame:
    """Of _signed's rows those whose signature documents of two ids have, and the texts' own rows.

    Rows come sorted by signature and pass through: of a signature that one document alone has had so far one row is held, and
    once another has it, its rows leave as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, None  # the row of the last signature so far, or that signature if two documents have it
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            sig, doc = batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy()
            if not len(sig):
                continue
            starts = np.flatnonzero(np.diff(sig, prepend=sig[0] ^ 1))
            many = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            many[0] |= sig[0] == known
            last = int(sig[-1])
            held, known = (None, last) if many[-1] else (batch.slice(int(starts[-1]), 1), None)
            if last < 0:  # a text's own row needs no partner
                held = None
            many |= sig[starts] < 0
            rows = np.flatnonzero(np.repeat(many, np.diff(starts, append=len(sig))))
            if len(rows):
                yield batch.take(pa.array(rows))

    return signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "sig long, doc_id long, kn long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n (the set's size) and the set itself, for docs that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(ends), pa.int64()), held], names=["doc_id", "n", "set"])

        ids, sets, size = [], [], 0
        for batch in batches:
            for doc, t in zip(batch.column(0), batch.column(1), strict=True):
                if len(s := shingles(t.as_py(), n)):
                    ids.append(doc.as_py())
                    sets.append(s)
                    size += len(s)
                if size > 1_000_000:
                    yield made()
                    ids, sets, size = [], [], 0
        if sets:
            yield made()

    return docs.mapInArrow(run, "doc_id long, n long, set array<long>")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked.

    Pairs meet at b: b's set goes to each of the tasks that its pairs are spread over, and with every pair goes a's.
    """
    salt = F.pmod(F.xxhash64("a"), F.lit(64)).cast("int")
    pairs = merged_if_large(written(pairs.withColumn("salt", salt), "pairs"))
    a_side = sets.join(pairs, F.col("doc_id") == F.col("a")).select("b", "salt", "a", "set")
    # a null marks the set of b itself; it sorts first.
    b_side = sets.join(pairs.select("b", "salt").distinct(), F.col("doc_id") == F.col("b")).select(
        "b", "salt", F.lit(None).cast("long").alias("a"), "set"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found_a, found_b = [], []
            b, salt, a, held = batch.columns
            for i in range(batch.num_rows):
                now = b[i].as_py(), salt[i].as_py()
                if now != key:
                    key, own = now, []
                s = held[i].values.to_numpy()
                if a[i].as_py() is None:
                    own.append(s)
                elif any(linked(s, o, percent) for o in own):
                    found_a.append(a[i].as_py())
                    found_b.append(now[0])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    met = a_side.unionByName(b_side).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return met.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (a, b) -> node, component (the smallest node it reaches), for nodes with edges.

    With few rounds a component may still have several names, but no name is two components'. Large-star and small-star in turn: nodes hand the smallest neighbour to the larger ones, then to the smaller ones,
    until every node hangs on its smallest. Each round is a written table; the driver gets two numbers of it. A hot
    node's neighbours are never collected: the smallest is an aggregate, which is joined back.
    """

    def smallest(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = state(now)
    for left in range(rounds, 0, -1):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = merged_if_large(smallest(both), seen[0])
        stars = (
            both.where("v > u").join(large, "u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a != b").distinct()
        )
        stars, before = written(stars, "edges"), now
        down = stars.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = merged_if_large(smallest(down), seen[0])
        now = written(
            down.join(small, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a != b").distinct(),
            "edges",
        )
        discard(stars, before)
        if left == 1 or (after := state(now)) == seen:
            break
        seen = after
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return named.groupBy("node").agg(F.min("component").alias("component"))


#: Sizes within this ratio are looked at together when shared features are counted.
STEP = 1.03


def _possible(features: DataFrame, percent: int) -> DataFrame:
    """doc_id of features (f, doc_id, n, component) that share enough of them with sets of one size outside their component.

    Of two linked sets of sizes n and s each holds at least p (n + s) / (100 + p) features that the other has. So a set's
    features that two components hold are counted for each narrow range of sizes in which anyone holds them; so no set that has a
    link goes, and a few without one stay. What is joined back is one row for each feature: the ranges it is held in as bits,
    which come round after 64 ranges, more than linked sets can lie apart.
    """
    reach = math.ceil(math.log(100 / percent) / math.log(STEP)) + 1
    rows = features.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(STEP)).cast("int"))
    held = rows.groupBy("f").agg(F.expr("bit_or(shiftleft(1L, band % 64))").alias("bands"), F.min("component").alias("low"), F.max("component").alias("high"))
    held = held.where("low != high").select("f", "bands")
    steps = range(-reach, reach + 1)
    per = rows.join(held, "f").groupBy("doc_id", "n", "band").agg(*[F.expr(f"sum(shiftrightunsigned(bands, (band + {64 + t}) % 64) & 1L)").alias(f"t{t + reach}") for t in steps])
    enough = F.lit(False)
    for t in steps:
        least = F.greatest(F.floor(F.pow(F.lit(STEP), F.col("band") + t)).cast("long"), F.expr(f"(n * {percent} + 99) div 100"))
        enough |= (F.col(f"t{t + reach}") * (100 + percent) >= percent * (F.col("n") + least)) & (F.col("band") + t >= 0)
    return per.where(enough).select("doc_id").distinct()


def _centres(rows: DataFrame) -> DataFrame:
    """doc_id, c: for each document of rows (sig, doc_id, key, n, share) the two centres that it meets most often.

    A signature's centre is its document with the largest share of shared signatures: among near copies of one text that is the
    text they stem from. Only one row a signature is joined back.
    """
    best = rows.groupBy("sig").agg(F.max(F.struct("share", F.col("doc_id").alias("c"))).alias("best")).select("sig", "best.c", F.col("best.share").alias("s"))
    times = rows.join(best, "sig").where("doc_id != c").groupBy("doc_id", "c", "s").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("times").desc(), F.col("s").desc(), "c"))
    return times.withColumn("place", place).where("place <= 2").select("doc_id", "c")


def _by_centre(features: DataFrame, refs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components that may be linked and have a centre in common.

    features: f, doc_id, n, component; refs: doc_id, c, and the centres' own features. With x the features that a document
    has in common with the centre, two documents have at most the smaller x and their common features outside the centre in
    common. So pairs meet by a feature outside the centre, or, where the x alone would do, by their size.
    """
    centres = refs.select("c").distinct()
    inside = features.join(centres.withColumnRenamed("c", "doc_id"), "doc_id").select("f", F.col("doc_id").alias("c"), F.lit(1).alias("in")).distinct()
    laid = features.where("wanted").drop("wanted").join(refs, "doc_id").join(inside, ["f", "c"], "left")
    laid = written(laid.repartition("c", "f"), "laid")
    common = laid.groupBy("doc_id", "n", "component", "c").agg(F.sum(F.coalesce("in", F.lit(0))).alias("x"))
    out = laid.where("`in` is null").drop("in")
    met = out.groupBy("c", "f").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("c", "f")
    out = out.join(met, ["c", "f"])
    able = (
        out.groupBy("doc_id", "n", "c").agg(F.count("*").alias("u")).join(common, ["doc_id", "n", "c"])
        .where(f"(u + x) * {100 + percent} >= {percent} * (n + (n * {percent} + 99) div 100)").select("doc_id", "n", "c", "x")
    )
    out = written(out.join(able, ["doc_id", "n", "c"]), "outside")
    sides = [out.select("c", "f", *[F.col(x).alias(f"{x}_{s}") for x in ("doc_id", "n", "component", "x")]) for s in "ab"]
    by_feature = (
        sides[0].join(sides[1], ["c", "f"]).where("component_a < component_b").groupBy("c", "doc_id_a", "doc_id_b", "n_a", "n_b", "x_a", "x_b")
        .agg(F.count("*").alias("u")).where(f"(u + least(x_a, x_b)) * {100 + percent} >= {percent} * (n_a + n_b)")
    )
    # The larger one asks for each size at which the features inside the centre are enough.
    most = f"least(n, (x * {100 + percent}) div {percent} - n)"
    asks = common.withColumn("low", F.expr(f"(n * {percent} + 99) div 100")).withColumn("most", F.expr(most)).where("low <= most")
    asks = asks.select("c", F.explode(F.sequence("low", "most")).alias("n_b"), *[F.col(x).alias(f"{x}_a") for x in ("doc_id", "n", "component", "x")])
    answers = common.select("c", *[F.col(x).alias(f"{x}_b") for x in ("doc_id", "n", "component", "x")])
    by_size = asks.join(answers, ["c", "n_b"]).where(f"component_a != component_b and x_b * {100 + percent} >= {percent} * (n_a + n_b)")
    both = [p.select(F.greatest("doc_id_a", "doc_id_b").alias("a"), F.least("doc_id_a", "doc_id_b").alias("b")) for p in (by_feature, by_size)]
    return both[0].union(both[1]).distinct()


def _apart(rows: DataFrame, refs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components that share as many signatures as linked sets, with no centre in common."""
    own = refs.groupBy("doc_id").agg(F.array_sort(F.collect_set("c")).alias("refs"))
    rows = rows.join(own, "doc_id", "left").withColumn("refs", F.coalesce("refs", F.array("doc_id")))
    ends = [f(x).alias(f"{n}_{x}") for x in ("component", "refs") for n, f in (("low", F.min), ("high", F.max))]
    mixed = rows.groupBy("sig", "key").agg(*ends).where("low_component != high_component and low_refs != high_refs").select("sig", "key")
    rows = written(rows.join(mixed, ["sig", "key"]), "apart")
    x, y = rows.alias("x"), rows.alias("y")
    sizes = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    differ = f"(na + nb) * {100 - percent} div {100 + percent}"
    return (
        x.join(y, F.expr(f"x.sig = y.sig and x.key = y.key and x.doc_id > y.doc_id and x.component != y.component and not arrays_overlap(x.refs, y.refs) and {sizes}"))
        .groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.key").alias("key"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        .agg(F.count("*").alias("times")).join(F.broadcast(shape), "key").where(f"times >= {need(differ)}").select("a", "b").distinct()
    )


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) for each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # Rows with the same text: the smallest id stands for all. Texts without words are alone.
    named = texts.withColumn("sha", F.when(F.col("text").rlike(WORD), F.unhex(F.sha2("text", 256)))).withColumn("name", F.xxhash64("sha").bitwiseAND((1 << 63) - 1))
    rows = written(named.select("doc_id", "sha", "name"), "texts")
    same = rows.where("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    keyed = written(join_small(rows, same, ["sha"]).withColumn("rep", F.coalesce("rep", "doc_id")).drop("sha"), "classes")
    copies = written(keyed.where("not rep <=> doc_id").select("doc_id", "name", F.lit(1).alias("copy")).distinct(), "copies")
    single = join_small(named.drop("sha"), copies, ["doc_id", "name"]).where("copy is null").select("doc_id", "text", "name")
    shape = spark.createDataFrame(shapes(percent), "key long, groups long, d long")  # a row for each of some hundred bands

    # 1. Signatures, and the documents with as many shared ones as any link needs.
    met = _met(_signed(single, n, percent)).select("sig", "doc_id", F.shiftright("kn", 40).alias("key"), F.expr("kn & ((1L << 40) - 1)").alias("n"))
    met = written(met, "shared")
    sizes = met.where("sig < 0").groupBy("doc_id", F.col("sig").bitwiseAND((1 << 63) - 1).alias("name")).agg(F.min("n").alias("n_shingles"))
    shared = met.where(f"sig >= 0 and sig < {WHOLE}")
    alike = met.where(f"sig >= {WHOLE}")
    first = alike.groupBy("sig", "key", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep != last").drop("last")
    equal = join_small(alike, first, ["sig", "key", "n"], "inner").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    single = single.where("doc_id is not null").drop("name")
    most = f"(n + n * 100 div {percent}) * {100 - percent} div {100 + percent}"
    own = shared.groupBy("doc_id", "key", "n").agg(F.count("*").alias("own")).join(F.broadcast(shape), "key").where(f"own >= {need(most)}")
    own = merged_if_large(written(own.select("doc_id", "key", "n", F.expr("1000 * own div (3 * groups - d)").alias("share")), "own"))

    # 2. Their sets, and the documents that share enough features.
    sets = written(_sets(join_small(single, own.select("doc_id").distinct(), ["doc_id"], "left_semi"), n), "sets")
    features = sets.select("doc_id", "n", F.explode("set").alias("f"))
    able = merged_if_large(written(_possible(features.withColumn("component", F.col("doc_id")), percent), "able"))
    rows = written(shared.join(own, ["doc_id", "key", "n"]).join(able, "doc_id", "left_semi"), "rows")

    # 3. Each with its centres.
    refs = written(_centres(rows), "centres")
    links = written(_verified(sets, refs.select(F.col("doc_id").alias("a"), F.col("c").alias("b")), percent), "links")

    # 4. What may be linked across the components that this gives.
    comps = merged_if_large(written(components(links, rounds=2), "components")).withColumnRenamed("node", "doc_id")
    features = features.join(able, "doc_id", "left_semi").join(comps, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    features = written(features, "features")
    able = merged_if_large(written(_possible(features, percent), "able")).withColumn("wanted", F.lit(True))
    rows = rows.join(able.drop("wanted"), "doc_id", "left_semi").join(comps, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    refs = refs.union(refs.select("c", "c")).distinct().join(able.drop("wanted"), "doc_id", "left_semi")
    refs = merged_if_large(written(refs, "centres"))
    wanted = features.join(able, "doc_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    rest = _by_centre(wanted, refs, percent).union(_apart(rows, refs, shape, percent)).distinct()
    links = written(links.union(_verified(sets, rest, percent)), "links")

    # Copies, equal sets, and rows of one id with several texts link them.
    tied = keyed.where("doc_id is not null and rep != doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    comps = merged_if_large(written(components(links.union(tied).union(equal)), "components"))
    discard(sets, features, links)
    return join_big(_sized(keyed, sizes), comps).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sized(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, n_shingles of rows keyed (doc_id, name, rep): copies meet the size of the text they are copies of, others their own."""
    sizes = sizes.select(F.col("doc_id").alias("rep"), "name", "n_shingles")
    copied = keyed.where("not rep <=> doc_id")
    on = lambda a, b: a["rep"].eqNullSafe(b["rep"]) & (a["name"] == b["name"])
    first = keyed.where("rep <=> doc_id").alias("k").join(sizes.alias("s"), F.expr("k.rep <=> s.rep and k.name = s.name"))
    asked = copied.select("rep", "name").distinct()
    again = join_small(copied, sizes.join(asked, on(sizes, asked), "left_semi"), ["rep", "name"], "inner")
    return first.select("k.doc_id", "s.n_shingles").union(again.select("doc_id", "n_shingles"))


def join_big(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with their node's component; a document is one node, so no key is hot."""
    return rows.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
