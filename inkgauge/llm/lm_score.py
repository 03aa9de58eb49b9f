"""Masked pseudo-likelihood: a bidirectional window network, in numpy, predicts every token from both sides.

Tokens are words, lower-cased and split at white space. The network sees the classes of `SIDE` words before and behind
a masked one: embeddings, one hidden layer, and a softmax over the corpus's most frequent words and one class for all
others. Classes grow with the corpus, as a fifth of the square root of its tokens, up to `MOST_CLASSES`, so the softmax has two levels: classes are
laid by frequency into as many groups as each holds, a group's probability is given both sides, and a class's given its
group and both sides. A word without a class is also spelt, byte by byte, from the same hidden layer: each byte's
probability is the corpus's for the byte before it, tilted by what both sides say and normalised again. So the
vocabulary is open, and any word is predicted from both sides, though a neighbour without a class of its own is seen as other only. A document's
score is the sum of the log probabilities of its words, each given both sides.

What is learnt covers all documents: word counts and byte pairs of every text, and `ROUNDS` rounds, each of which trains on every
word of those documents that a hash of their text deals to it, so every word is learnt once. Within a round the hash deals
documents to shards, whose number follows from the corpus's tokens, and orders them there; shards start from what the round
before arrived at, and their parameters are averaged by the words they saw. So the model depends on the documents alone: not on
their order, on how files are split, or on a task that ran twice. Counts and parameters are summed on the executors; the driver gets
the classes' words, the byte pairs and a few parameter sets.

Defined results: null or empty text has no tokens, a score of 0 and a null mean; an empty table gives no rows; ties in
word counts go to the smaller word; repeated rows score alike (scores are rounded to thousandths, beyond which sums in single
precision depend on what is computed with them); extra columns aren't kept.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_of, written

LEAST_CLASSES, MOST_CLASSES, SIDE, WIDTH, HIDDEN = 256, 250 * 250, 2, 8, 16
ROUNDS, BATCH, RATE = 2, 8192, 0.02
#: Words that a shard is to have, and as many at least for each parameter.
SHARD_WORDS, WORDS_A_PARAMETER = 1_000_000, 4
TABLE_WORDS, SLICE_CHARS, POSITIONS = 300_000, 1 << 20, 32_768
#: Class 0 is for all other words.
OTHER = 0
#: Word counts are compared by this many ranges for each doubling when classes are chosen.
RANGES = 64


def slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = text.find(" ", at + SLICE_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _counts(docs: DataFrame) -> DataFrame:
    """word, n for every word; under the null word, the byte pair counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(words, pairs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64()), pa.array(pairs, pa.binary())],
                names=["word", "n", "pairs"],
            )

        seen: Counter = Counter()
        pairs, held, size = np.zeros(1 << 16, np.int64), [], 0

        def count() -> None:
            b = np.frombuffer(" ".join(["", *held, ""]).encode(), np.uint8).astype(np.uint16)
            np.add(pairs, np.bincount((b[:-1] << 8) | b[1:], minlength=1 << 16), out=pairs)

        for batch in batches:
            for t in batch.column(0):
                for part in slices(t.as_py().lower()):
                    seen.update(part.split())
                    held.append(part)
                    size += len(part)
                    if size > SLICE_CHARS:
                        count()
                        held, size = [], 0
                if len(seen) > 2 * TABLE_WORDS:
                    yield made(list(seen.items()), [None] * len(seen))
                    seen.clear()
        for at in range(0, len(seen), TABLE_WORDS):
            part = list(seen.items())[at : at + TABLE_WORDS]
            yield made(part, [None] * len(part))
        if held:
            count()
        yield made([(None, 1)], [pairs.tobytes()])

    return docs.select("text").mapInArrow(run, "word string, n long, pairs binary")


def _summed(rows: DataFrame, column: str, dtype: str, reducers: int = 32) -> DataFrame:
    """rows(pid, w, column) with arrays of numbers -> a row for each of the reducers with their weighted sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for batch in batches:
            for w, x in zip(batch.column("w"), batch.column(column), strict=True):
                a = np.frombuffer(x.as_py(), dtype).astype(np.float64) * w.as_py()
                total, weight = a if total is None else total + a, weight + w.as_py()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["w", "x"])

    return rows.repartition(reducers, "pid").sortWithinPartitions("pid").mapInArrow(run, "w double, x binary")


def _collected(rows: DataFrame) -> tuple[float, np.ndarray | None]:
    found = sorted((bytes(r["x"]), r["w"]) for r in rows.collect())
    if not found:
        return 0.0, None
    return sum(w for _, w in found), np.sum([np.frombuffer(x) for x, _ in found], axis=0)


@dataclass
class Vocabulary:
    """The words with a class, most frequent first, with their counts, all tokens, and the spelling of the rest."""

    words: list[str]
    counts: list[int]
    tokens: int
    spelling: Spelling

    @property
    def base(self) -> int:
        """As many groups of classes, each of as many, hold class OTHER and the words."""
        return max(2, math.isqrt(len(self.words)) + 1)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Of all documents."""
    counts = written(_counts(docs), "words")
    totals = written(
        counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).withColumn("range", F.floor(F.log2("n") * RANGES).cast("int")),
        "vocabulary",
    )
    pairs = counts.where("word is null").select(F.monotonically_increasing_id().alias("pid"), F.lit(1.0).alias("w"), "pairs")
    _, total = _collected(_summed(pairs, "pairs", "<i8"))
    ranges = sorted(totals.groupBy("range").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect(), reverse=True)  # some thousands at most
    tokens = sum(r["n"] for r in ranges)
    most, have, least = min(MOST_CLASSES, max(LEAST_CLASSES, math.isqrt(tokens) // 5)) - 1, 0, None
    for r in ranges:
        if (have := have + r["k"]) > most:
            break
        least = r["range"]
    found = totals.where(F.col("range") >= least).collect() if least is not None else []
    found.sort(key=lambda r: (-r["n"], r["word"]))
    return Vocabulary([r["word"] for r in found], [r["n"] for r in found], tokens, Spelling((np.zeros(1 << 16) if total is None else total).reshape(256, 256)))


class Spelling:
    """Words as byte pairs; symbols are the bytes that the corpus's words hold, and the blank around each word."""

    def __init__(self, counts: np.ndarray):
        seen = counts.sum(0) + counts.sum(1) > 0
        seen[[*range(0x09, 0x0E), *range(0x1C, 0x20)]] = False  # words are split there
        seen[0x20] = True
        self.symbol = np.where(seen, np.cumsum(seen) - 1, 0).astype(np.uint8)
        self.size = int(seen.sum())
        table = counts[np.ix_(seen, seen)] + 0.01
        table = table / table.sum(1, keepdims=True)
        self.log, self.table = np.log(table), table.astype(np.float32)


@dataclass
class Spelt:
    """The symbols of words one behind another, a blank before each, and where each word's begin and how many pairs it has."""

    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte pair of these words: its word's place among them, and its two symbols."""
        n = self.lengths[words]
        at = np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(n)), n), *(self.symbols.take(x).astype(np.int64) for x in (at, at + 1))

    @staticmethod
    def joined(parts: list[Spelt]) -> Spelt:
        shift = np.cumsum([0, *(len(p.symbols) for p in parts[:-1])])
        return Spelt(
            np.concatenate([p.symbols for p in parts]), np.concatenate([p.starts + k for p, k in zip(parts, shift, strict=True)]),
            np.concatenate([p.lengths for p in parts]),
        )


class Words:
    """Words to classes, and the spelling of those without one of their own."""

    def __init__(self, words: list[str], spelling: Spelling):
        self.spelling = spelling
        self.classes = {w: i + 1 for i, w in enumerate(words)}

    def __call__(self, text: str) -> tuple[np.ndarray, Spelt]:
        """Classes of the text's words, and how its words of class OTHER are spelt."""
        ids, raw = [], []
        for part in slices(text.lower()):
            words = part.split()
            if words:
                found = np.fromiter(map(self.classes.get, words, repeat(OTHER)), np.int32, len(words))
                ids.append(found)
                others = found == OTHER
                raw += [b" ", " ".join(compress(words, others.tolist())).encode()] if others.any() else []
        b = np.frombuffer(b"".join([*raw, b" "]), np.uint8)
        edges = np.flatnonzero(b == 0x20)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), Spelt(self.spelling.symbol[b], edges[:-1], np.diff(edges))


def shapes(base: int) -> tuple[tuple[int, ...], ...]:
    """Embeddings (the last one is for what lies outside the text), hidden layer, groups, and classes by group."""
    return (base * base + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, base), (base,), (base, HIDDEN, base), (base, base)


def size_of(base: int) -> int:
    """Parameters of these shapes; behind them come those of spelling, for each symbol one from each hidden unit."""
    return sum(int(np.prod(s)) for s in shapes(base))


def unpacked(flat: np.ndarray, base: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(base):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def start(seed: int, base: int, symbols: int = 0, counts: np.ndarray | None = None) -> np.ndarray:
    """Parameters that give each class the share it has by counts, whatever is around it."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(size_of(base) + HIDDEN * symbols)
    e, w1, _, w2, b2, w3, b3 = unpacked(flat, base)
    for part, spread in ((e, 0.3), (w1, 1 / np.sqrt(len(w1))), (w2, 0.1), (w3, 0.1)):
        part[:] = rng.standard_normal(part.shape) * spread
    n = np.zeros(base * base)
    if counts is not None:
        n[: len(counts)] = counts
    n = n.reshape(base, base) + 0.1
    b2[:], b3[:] = np.log(n.sum(1) / n.sum()), np.log(n / n.sum(1, keepdims=True))
    return flat.astype(np.float32)


def contexts(ids: np.ndarray, outside: int) -> np.ndarray:
    """For each word the classes around it: a row of 2 SIDE."""
    padded = np.concatenate([np.full(SIDE, outside, np.int32), ids, np.full(SIDE, outside, np.int32)])
    return np.stack([padded[k : k + len(ids)] for k in range(2 * SIDE + 1) if k != SIDE], 1)


def _exponentials(z: np.ndarray, safe: bool) -> np.ndarray:
    """exp(z) in place, each row less its largest unless none can leave the range of its exponential; returns what was taken off."""
    low = np.float32(0) if safe else z.max(1, keepdims=True)
    if not safe:
        z -= low
    np.exp(z, out=z)
    return low


class Network:
    def __init__(self, flat: np.ndarray, base: int, spelling: Spelling | None = None):
        self.flat, self.base, self.size = flat.astype(np.float32).copy(), base, size_of(base)
        self.parts, self.spelling = unpacked(self.flat, base), spelling
        self.m, self.v, self.t, self.grads = None, None, 0, None

    def spelt(self, h: np.ndarray, pairs: tuple[np.ndarray, ...], grad: np.ndarray | None = None) -> np.ndarray:
        """The log probability of spelling each word by its byte pairs, given the hidden layers; with grad, which gets
        the gradient of their negative sum by the parameters, instead that by h.

        A byte b behind a has the probability table[a, b] e[b] / z[a], where e depends on the word's sides and z is the
        sum of table[a] e: so a word needs one product with the table, however long it is.
        """
        (row, first, second), k, s = pairs, self.spelling.size, self.spelling
        u = self.flat[self.size :].reshape(HIDDEN, k)
        a = np.clip(h @ u, -30, 30)
        e = np.exp(a)
        at, to = row * k + first, row * k + second
        z = (e @ s.table.T).ravel().take(at)
        if grad is None:
            one = s.log.take(first * k + second) + a.ravel().take(to) - np.log(z)
            return np.bincount(row, one, len(h))
        seen = np.bincount(at, 1 / z, len(h) * k).astype(np.float32).reshape(-1, k)
        e *= seen @ s.table
        e -= np.bincount(to, minlength=len(h) * k).reshape(-1, k)
        grad.reshape(HIDDEN, k)[:] = h.T @ e
        return e @ u.T

    def bounded(self) -> bool:
        """Whether no logit can leave the range of its exponential: hidden units lie within 1."""
        w2, b2, w3, b3 = self.parts[3:]
        return max(float((np.abs(w).sum(-2) + np.abs(b)).max()) for w, b in ((w2, b2), (w3, b3))) < 80

    def classes(self, h: np.ndarray, y: np.ndarray, safe: bool = False, grads: list[np.ndarray] | None = None) -> np.ndarray:
        """The log probability of each class y given the hidden layers; with grads (those of the last four parts), which get the gradient
        of their negative sum, instead that by h. Rows are laid by their group, so each group's are a slice."""
        w2, b2, w3, b3 = self.parts[3:]
        group, place = np.divmod(y, self.base)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        group, place, h = group.take(order), place.take(order), h.take(order, axis=0)
        edges = np.searchsorted(group, np.arange(self.base + 1))
        if grads is not None:
            grads[2][:] = 0
            grads[3][:] = 0

        def level(own: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, gw: np.ndarray | None, gb: np.ndarray | None) -> np.ndarray:
            z = own @ w
            z += b
            at = np.arange(len(y)), y
            right = z[at]
            low = _exponentials(z, safe)
            total = z.sum(1, keepdims=True)
            if gw is None:
                return right - (low + np.log(total))[:, 0]
            z /= total
            z[at] -= 1
            np.matmul(own.T, z, out=gw)
            z.sum(0, out=gb)
            return z @ w.T

        made = level(h, group, w2, b2, *(grads[:2] if grads is not None else (None, None)))
        for g in np.flatnonzero(np.diff(edges)):
            i, j = edges[g], edges[g + 1]
            made[i:j] += level(h[i:j], place[i:j], w3[g], b3[g], *((grads[2][g], grads[3][g]) if grads is not None else (None, None)))
        out = np.empty_like(made)
        out[order] = made
        return out

    def step(self, ctx: np.ndarray, y: np.ndarray, pairs: tuple[np.ndarray, ...] | None = None) -> None:
        """One step of Adam on masked words y between ctx; pairs: the byte pairs of those of class OTHER."""
        if self.grads is None:
            self.m, self.v, self.grads = (np.zeros_like(self.flat) for _ in range(3))
        e, w1, b1 = self.parts[:3]
        ge, g1, gb1, *rest = unpacked(self.grads, self.base)
        n = len(y)
        x = e.take(ctx, axis=0).reshape(n, -1)  # much faster than by brackets
        h = np.tanh(x @ w1 + b1)
        dh = self.classes(h, y, self.bounded(), rest)
        if pairs is not None:
            others = np.flatnonzero(y == OTHER)
            dh[others] += self.spelt(h[others], pairs, self.grads[self.size :])
        dh *= 1 - h * h
        g1[:], gb1[:] = x.T @ dh, dh.sum(0)
        dx, ge[:] = (dh @ w1.T).reshape(-1, WIDTH), 0
        flat = ctx.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # there are fewer classes
        flat = flat.take(order)
        at = np.flatnonzero(np.diff(flat, prepend=-1))
        ge[flat[at]] = np.add.reduceat(dx.take(order, axis=0), at, axis=0)
        self.grads /= n
        self.t += 1
        self.m += 0.1 * (self.grads - self.m)
        self.v += 0.001 * (self.grads**2 - self.v)
        rate = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        self.flat -= (rate * self.m / (np.sqrt(self.v) + 1e-8)).astype(np.float32)

    def log_probabilities(self, docs: list[tuple[np.ndarray, Spelt]]) -> np.ndarray:
        """For each document the sum over its words, each given both sides."""
        e, w1, b1 = self.parts[:3]
        sides = [e @ w1[k * WIDTH : (k + 1) * WIDTH] for k in range(2 * SIDE)]
        lengths = np.array([len(ids) for ids, _ in docs])
        edge = np.full(SIDE, self.base * self.base, np.int32)
        padded = np.concatenate([edge, *(x for ids, _ in docs for x in (ids, edge))])
        of = np.repeat(np.arange(len(docs)), lengths)
        spelt = Spelt.joined([s for _, s in docs])
        total, done, safe = np.zeros(len(docs)), 0, self.bounded()
        for at in range(0, len(of), POSITIONS):
            own = of[at : at + POSITIONS]
            place = np.arange(at, at + len(own)) + SIDE * (own + 1)
            y = padded[place]
            h = sum(s.take(padded.take(place + k), axis=0) for s, k in zip(sides, (k for k in range(-SIDE, SIDE + 1) if k), strict=True))
            h += b1
            np.tanh(h, out=h)
            one = self.classes(h, y, safe).astype(np.float64)
            if self.spelling is not None and len(others := np.flatnonzero(y == OTHER)):
                one[others] += self.spelt(h[others], spelt.pairs(np.arange(done, done + len(others))))
                done += len(others)
            total += np.bincount(own, one, len(docs))
        return total


def train(texts: Iterator[str], to_classes: Words, net: Network, seed: int) -> int:
    """Trains net on the texts' words, each masked once; the number of words it was trained on."""
    rng, seen = np.random.default_rng(seed), 0
    held: list[tuple[np.ndarray, np.ndarray, Spelt]] = []
    have = 0

    def steps() -> None:
        c, y = (np.concatenate([h[k] for h in held]) for k in range(2))
        spelt = Spelt.joined([h[2] for h in held])
        place = np.cumsum(y == OTHER) - 1  # of words of class OTHER among themselves
        mixed = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            part = mixed[s : s + BATCH]
            net.step(c[part], y[part], spelt.pairs(place[part][y[part] == OTHER]))

    for text in texts:
        ids, spelt = to_classes(text)
        if not len(ids):
            continue
        held.append((contexts(ids, net.base * net.base), ids, spelt))
        have += len(ids)
        if have >= 16 * BATCH:
            steps()
            seen, held, have = seen + have, [], 0
    if have:
        steps()
    return seen + have


def _round(docs: DataFrame, known: Vocabulary, flat: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """The parameters that all shards of a round arrive at from flat, averaged by the words they trained on."""
    words, spelling, base = known.words, known.spelling, known.base
    shards = max(1, round(known.tokens / ROUNDS / max(SHARD_WORDS, WORDS_A_PARAMETER * len(flat))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_classes, at, rows = Words(words, spelling), None, iter(())

        def ordered() -> Iterator[tuple[int, str]]:
            for batch in batches:
                for shard, t in zip(batch.column("shard"), batch.column("text"), strict=True):
                    yield shard.as_py(), t.as_py()

        rows = ordered()
        at = next(rows, None)
        while at is not None:
            shard, net = at[0], Network(flat, base, spelling)

            def own() -> Iterator[str]:
                nonlocal at
                while at is not None and at[0] == shard:  # noqa: B023
                    yield at[1]
                    at = next(rows, None)

            seen = train(own(), to_classes, net, seed + shard)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([float(seen)]), pa.array([net.flat.tobytes()], pa.binary())], names=["pid", "w", "p"])

    hashed = docs.select("text", F.xxhash64(F.lit(seed), "text").alias("h")).where(F.pmod("h", F.lit(ROUNDS)) == turn)
    dealt = hashed.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)))
    # A shard is a task's: a bounded number of words and the texts they end in.
    laid = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "h", "text")
    trained = laid.select("shard", "text").mapInArrow(run, "pid long, w double, p binary")
    weight, total = _collected(_summed(trained, "p", "<f4", max(1, min(32, (1 << 23) // len(flat)))))
    return flat if total is None else (total / weight).astype(np.float32)


_ready: dict[str, tuple[Words, Network]] = {}


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed), mean_log_likelihood (a token)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    known = vocabulary(texts)
    words, spelling, base = known.words, known.spelling, known.base
    flat = start(seed, base, spelling.size, np.array([known.tokens - sum(known.counts), *known.counts]))
    for turn in range(ROUNDS if known.tokens else 0):
        flat = _round(texts, known, flat, seed, turn)
    name = hashlib.sha256(flat.tobytes() + "\n".join(words).encode() + spelling.symbol.tobytes() + spelling.table.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ready:
            _ready.clear()
            _ready[name] = Words(words, spelling), Network(flat, base, spelling)
        to_classes, net = _ready[name]
        for batch in batches:
            counts, sums, held, have = [], [], [], 0
            for t in batch.column("text"):
                held.append(to_classes(t.as_py()))
                counts.append(len(held[-1][0]))
                have += counts[-1]
                if have >= 4 * POSITIONS:
                    sums.append(net.log_probabilities(held))
                    held, have = [], 0
            if held:
                sums.append(net.log_probabilities(held))
            made = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(np.round(made, 3) + 0.0)], names=["doc_id", "n_tokens", "log_likelihood"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double").withColumn(
        "mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    )
