"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A text's windows are its words: on held-out rows windows of two, three, four and six words told the classes apart worse (README
has the figures). Each is compressed with either dictionary, between a head and a tail that both hold, so that even
a short window is searched and its marginal length shows. How many bytes the toxic dictionary saves against the ordinary
one is compared with several thresholds, calibrated on the ordinary labelled texts so that set shares of their windows lie above them; how many and
which share of a text's windows exceed each of them, weighed by a logistic fit on the labelled rows, makes the score.

Fitting takes at most `rows_a_class` labelled texts of each class (those first by a seeded hash, texts of at most
`fit_chars` characters); this is the bound of the sample. Both classes are counted over all learnable labels, and the
sample's rows weigh as much as their class has labels for each, so the cut at 0.5 means the same at every size. The toxic dictionary is trained on the windows of toxic
texts that hold a character 5-gram which is several times as frequent in toxic texts as in ordinary ones: trained on
whole toxic texts it would mostly hold what both kinds share. Scoring runs over whole texts, row by row, in slices,
and shuffles nothing.

Defined results: null or empty text scores as a text without windows; a null id is not held out and not learnt from;
without labelled texts of both classes every score is the share of toxic ones (0 if there are none); repeated labels
of a document count once, toxic if any is; an empty table gives no rows; extra columns stay, but for those named like
what is added.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEAD, TAIL = b"0123456789abcdefghijklmnopqrstuvwxyz#", b"~QWERTYUIOPASDFG"
STRIP = ".,;:!?*#%&$\"'()[]{}<>|-_=+/\\`~"
LEVEL, GRAM = 3, 5
#: Thresholds are where so many of all ordinary windows save more bytes.
RATES = (0.1, 0.03, 0.01, 0.003, 0.001)
TABLE_WORDS, SLICE_CHARS = 200_000, 1 << 20


def slices(text: str) -> Iterator[str]:
    """text in parts of about SLICE_CHARS, cut at blanks."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = text.find(" ", at + SLICE_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def windows(text: str) -> list[str]:
    return text.lower().split()


def grams(word: str) -> set[str]:
    word = f" {word.strip(STRIP)} "
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)} or {word}


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the first is the intercept
    thresholds: tuple[int, ...] = ()


def saving(model: Model) -> Callable[[str], int]:
    """word -> bytes that the toxic dictionary saves."""
    import zstandard as zstd

    def length(raw: bytes) -> Callable[[bytes], bytes]:
        d = zstd.ZstdCompressionDict(raw + HEAD + TAIL)
        d.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress

    ordinary, toxic = length(model.ordinary), length(model.toxic)

    def one(word: str) -> int:
        # Past 256 bytes a window says nothing more about a word; longer ones are scored by their parts.
        raw = word.strip(STRIP).encode()
        best = None
        for at in range(0, max(1, len(raw)), 256):
            b = b"".join((HEAD, b" ", raw[at : at + 256], b" ", TAIL))
            d = len(ordinary(b)) - len(toxic(b))
            best = d if best is None else max(best, d)
        return best

    return one


def featurizer(model: Model) -> Callable[[str], np.ndarray]:
    one, table = saving(model), {}

    def features(text: str) -> np.ndarray:
        n, most, over = 0, 0, np.zeros(len(model.thresholds))
        for part in slices(text):
            words = windows(part)
            found = [*map(table.get, words)]
            if None in found:
                if len(table) > TABLE_WORDS:
                    table.clear()
                for i, (w, d) in enumerate(zip(words, found, strict=True)):
                    if d is None:
                        if (d := table.get(w)) is None:
                            d = table[w] = one(w)
                        found[i] = d
            if found:
                d = np.asarray(found)
                n, most = n + len(d), max(most, int(d.max()))
                over += [(d >= k).sum() for k in model.thresholds]
        share = over / max(n, 1)
        return np.concatenate([[most], np.log1p(over), share, np.sqrt(share)])

    return features


def _trained(samples: list[str], size: int) -> bytes:
    import zstandard as zstd

    raw = [s.encode() for s in samples if s]
    try:
        return zstd.train_dictionary(size, raw, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their own bytes are the dictionary
        return (b"".join(raw)[-size:]).rjust(8)


def _logistic(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A fit in which each row weighs `of`, on average 1."""
    mean = np.average(x, axis=0, weights=of)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=of)) + 1e-9
    z, w = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-6] + [1e-4 * len(y) + 0.1] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (of * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (of * (p - y)) + ridge @ w)
    return mean, scale, w


def _thresholds(model: Model, ordinary: list[str]) -> tuple[int, ...]:
    """Rising numbers of bytes, each the least that at most a share of RATES of the ordinary texts' windows saves."""
    words = Counter(w for t in ordinary for w in windows(t))
    one, saved = saving(model), Counter()
    for w, n in words.items():
        saved[one(w)] += n
    out, total = [], sum(saved.values())
    for rate in RATES:
        at = max(1, out[-1] + 1 if out else 1)
        while sum(n for d, n in saved.items() if d >= at) > rate * total:
            at += 1
        out.append(at)
    return tuple(out)


def fit_texts(toxic: list[str], ordinary: list[str], *, ordinary_bytes: int = 48 << 10, toxic_bytes: int = 16 << 10, rates: tuple[float, float] = (1.0, 1.0), most_chunks: int = 12_000) -> Model:
    """A model of labelled texts. Both lists must hold something. rates: the shares of all ordinary and of all toxic
    texts that the lists are. The ordinary dictionary is trained on chunks of 64 words, evenly spread ones if there are
    over most_chunks (the trainer's time grows with them, and its dictionary holds a thousandth of so many)."""

    def by_text(texts: list[str]) -> Counter:
        seen: Counter = Counter()
        for t in texts:
            seen.update(set().union(*map(grams, set(windows(t)))))
        return seen

    in_toxic, in_ordinary = by_text(toxic), by_text(ordinary)
    marks = {
        g for g, k in in_toxic.items()
        if k >= max(2, 0.005 * len(toxic)) and k / len(toxic) > 8 * (in_ordinary[g] + 0.5) / len(ordinary)
    }
    marked = [" " + " ".join(w.strip(STRIP) for w in windows(t) if grams(w) & marks) + " " for t in toxic]
    marked = [m for m in marked if m.strip()] or [" ".join(windows(t)) for t in toxic]
    chunks = []
    for t in ordinary:
        words = [w.strip(STRIP) for w in windows(t)]
        chunks += [f" {' '.join(words[i : i + 64])} " for i in range(0, len(words), 64)]
    chunks = [chunks[i * len(chunks) // most_chunks] for i in range(most_chunks)] if len(chunks) > most_chunks else chunks
    raw_toxic = _trained(marked * max(1, 3000 // len(marked)), toxic_bytes)
    base = Model(_trained(chunks, ordinary_bytes), raw_toxic, (), (), ())
    base = replace(base, thresholds=_thresholds(base, ordinary))
    features = featurizer(base)
    x = np.array([features(t) for t in (*toxic, *ordinary)])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    of = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    mean, scale, w = _logistic(x, y, of / of.mean())
    return replace(base, mean=tuple(mean), scale=tuple(scale), weights=tuple(w))


def learnable(id_col: str) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text isn't divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_a_class: int = 3000,
    fit_chars: int = 20_000,
    seed: int = 7,
) -> Model | float:
    """A model, or without texts of both classes the share of toxic ones."""
    known = (
        labels.where(learnable(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    )
    labelled = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), "__id")
    sample = [known.where(F.col("__y") == y).orderBy(order, "__id").limit(rows_a_class) for y in (0, 1)]
    rows = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
        .join(F.broadcast(sample[0].union(sample[1])), "__id")  # two ids a row, rows_a_class of each class
        .where(F.length("__t") <= fit_chars)
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"), F.min("__t").alias("__t"))
        .collect()
    )
    rows.sort(key=lambda r: str(r["__id"]))
    toxic, ordinary = ([r["__t"] for r in rows if r["__y"] == y and r["__t"].strip()] for y in (1, 0))
    if not toxic or not ordinary:
        return float(bool(toxic))
    return fit_texts(toxic, ordinary, rates=tuple(min(1.0, rows_a_class / labelled[y]) for y in (0, 1)))


_features: dict[str, Callable[[str], np.ndarray]] = {}


def scorer(model: Model | float) -> Callable[[str | None], float]:
    if isinstance(model, float):
        return lambda text: model
    key = hashlib.sha256(pickle.dumps(model)).hexdigest()
    features = _features.setdefault(key, featurizer(model))
    mean, scale, w = map(np.asarray, (model.mean, model.scale, model.weights))
    return lambda text: float(1 / (1 + np.exp(-np.clip(w[0] + ((features(text or "") - mean) / scale) @ w[1:], -30, 30))))


def score(docs: DataFrame, model: Model | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score and predicted."""
    added = {"score": "double", "held_out": "boolean", "predicted": "int"}
    rows = docs.drop(*added)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(model)
        for batch in batches:
            made = pa.array([one(t.as_py()) for t in batch.column(text_col)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, "score"])

    return (
        rows.mapInArrow(run, StructType([*rows.schema.fields]).add("score", "double"))
        .withColumn("held_out", F.coalesce(~learnable(id_col), F.lit(False)) & F.col(id_col).isNotNull())
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
