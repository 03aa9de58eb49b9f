"""Features of documents, as columns over arrays of tokens and sentences.

A document's tokens stay in its row: counts of types come from one pass over the sorted array, and no feature shuffles
the corpus. parsed() lays the arrays down once; the features below refer to its columns by name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .. import lexicon
from . import maths as M
from . import text as T

try:
    from _md5 import md5  # without the start-up of OpenSSL's, which is most of its time on short texts
except ImportError:
    from hashlib import md5


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with raw, toks, words, lowers, n (words), sents, sent_words (lower-cased), sent_lens (as doubles)."""
    return (
        docs.drop("scan", "word_counts").withColumn("raw", T.strip(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("toks", T.tokens(F.col("raw")))
        .withColumn("words", F.filter("toks", T.is_word))
        .withColumn("lowers", F.transform("words", F.lower))
        .withColumn("n", F.size("words"))
        .withColumn("sents", T.sentences(F.col("raw")))
        .withColumn("sent_words", F.transform("sents", T.lower_words))
        .withColumn(
            "sent_lens",
            F.when(F.size("sents") > 0, F.transform("sent_words", lambda s: F.size(s).cast("double"))).otherwise(F.array(F.col("n").cast("double"))),
        )
    )


def runs(items: str, kind: str = "bigint") -> Column:
    """Over the equal items of an array column: types, hapax (items that occur once), squares (of counts), entropy (in nats)."""
    source = f"sort_array({items})"
    share = f"a.r / cast(size({items}) as double)"
    closed = (
        f"'t', a.t + if(a.r > 0, 1L, 0L), 'h', a.h + if(a.r = 1, 1L, 0L), 'q', a.q + a.r * a.r, "
        f"'e', a.e - if(a.r > 0, {share} * ln({share} + 1e-12D), 0D)"
    )
    return F.expr(
        f"aggregate({source}, named_struct('p', cast(null as {kind}), 'r', 0L, 't', 0L, 'h', 0L, 'q', 0L, 'e', 0D), "
        f"(a, x) -> if(x <=> a.p, named_struct('p', a.p, 'r', a.r + 1L, 't', a.t, 'h', a.h, 'q', a.q, 'e', a.e), "
        f"named_struct('p', x, 'r', 1L, {closed})), "
        f"a -> named_struct('types', a.t + if(a.r > 0, 1L, 0L), 'hapax', a.h + if(a.r = 1, 1L, 0L), "
        f"'squares', a.q + a.r * a.r, 'entropy', a.e - if(a.r > 0, {share} * ln({share} + 1e-12D), 0D)))"
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


@lru_cache(200_000)
def _syllables(word: str) -> int:
    """As text.syllables()."""
    letters = re.sub("[^a-z]", "", word)
    return max(1, len(re.findall("[aeiouy]+", letters.removesuffix("e")))) if letters else 0


def lists(items: pa.Array) -> Iterator[list[str]]:
    """Each row's items of a list array, one row after the other: a batch's words are never all Python objects at once."""
    starts, values = items.offsets.to_numpy(), items.values
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield values.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()


_wholes = ("types", "hapax", "squares", "syllables", "letters", "contractions", "triples")


@F.arrow_udf(StructType([*[StructField(c, LongType()) for c in _wholes], StructField("pair_entropy", DoubleType())]))
def count_words(lowers: pa.Array) -> pa.Array:
    """Of a document's words: types, hapax (words that occur once), squares (of counts), syllables, letters (characters),
    contractions, triples (unlike runs of three words) and pair_entropy (of the runs of two, in nats).

    Counters in an Arrow batch, since folds over sorted arrays are not compiled in the JVM.
    """
    out = []
    for words in lists(lowers):
        seen, n = Counter(words), max(1, len(words) - 1)
        sizes, pairs = Counter(seen.values()), Counter(Counter(zip(words, words[1:])).values())  # noqa: B905
        out.append((
            len(seen), sizes[1], sum(r * r * k for r, k in sizes.items()), sum(_syllables(w) * k for w, k in seen.items()), sum(map(len, words)),
            sum(k for w, k in seen.items() if "'" in w), len(set(zip(words, words[1:], words[2:]))), -math.fsum(k * (r / n) * math.log(r / n + 1e-12) for r, k in pairs.items()),  # noqa: B905
        ))
    columns = zip(*out, strict=True) if out else [[]] * (len(_wholes) + 1)
    kinds = [*[pa.int64()] * len(_wholes), pa.float64()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_wholes, "pair_entropy"])


def counted(d: DataFrame) -> DataFrame:
    """parsed rows with word_counts, which richness, readability and style share."""
    return d if "word_counts" in d.columns else d.withColumn("word_counts", count_words("lowers"))


def richness(d: DataFrame) -> DataFrame:
    """parsed rows with ttr, hapax, yules_k, honores_r."""
    d, n = counted(d), F.col("n")
    v, v1 = F.col("word_counts.types"), F.col("word_counts.hapax")
    return (
        d.withColumn("ttr", _ratio(v, n)).withColumn("hapax", _ratio(v1, n))
        .withColumn("yules_k", F.when(n < 8, 0.0).otherwise(1e4 * (F.col("word_counts.squares") - n) / (n.cast("double") * n)))
        .withColumn("honores_r", F.when((n < 8) | (v1 == v), 0.0).otherwise(100 * F.log(n.cast("double")) / (1 - v1 / v)))
    )


def readability(sents: Column, words: Column, syllables: Column | None = None) -> Column:
    """Flesch reading ease; syllables, where they are counted already, are the words'."""
    return reading_ease(F.size(sents), F.size(words), T.total_syllables(words) if syllables is None else syllables)


def reading_ease(sents: Column, words: Column, syllables: Column) -> Column:
    """The same of their numbers."""
    return F.when((sents > 0) & (words > 0), 206.835 - 1.015 * words / sents - 84.6 * syllables / words).otherwise(0.0)


def sentence_lengths(d: DataFrame) -> DataFrame:
    """parsed rows with mean_sl, std_sl, burstiness, length_uniformity."""
    m, s, k = F.col("mean_sl"), F.col("std_sl"), F.size("sent_lens")
    return (
        d.withColumn("mean_sl", M.mean(F.col("sent_lens")))
        .withColumn("std_sl", M.sample_std(F.col("sent_lens"), F.col("mean_sl")))
        .withColumn("burstiness", F.when((k < 2) | (m <= 0), 0.0).otherwise(F.try_divide(s, m)))
        .withColumn("length_uniformity", F.when((k < 3) | (m <= 0), 0.0).otherwise(M.inv_logistic(F.try_divide(s, m), 0.38, 8.0)))
    )


def phrase_density(raw: Column, n: Column) -> Column:
    """Stock phrases by length: hedges, stock words, and each longer phrase that occurs."""
    low = F.lower(raw)
    bound = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
    hits = F.regexp_count(low, F.lit(bound % lexicon.HEDGES)) + F.regexp_count(low, F.lit(bound % lexicon.STOCK_WORDS))
    for p in lexicon.STOCK_PHRASES:
        hits = hits + F.contains(low, F.lit(p)).cast("int")
    return M.clamp(hits / F.greatest(F.lit(1.0), F.greatest(F.lit(1), n) / 80.0) / 3.0 * 1.4)


def opener_score(sents: Column) -> Column:
    """The share of the first eight and last three sentences that begin like a template."""
    k = F.size(sents)
    checked = F.concat(F.slice(sents, 1, 8), F.slice(sents, F.greatest(F.lit(1), k - 2), 3))

    def hit(s: Column) -> Column:
        head = F.substr(F.lower(s), F.lit(1), F.lit(48))
        near, found = F.substr(head, F.lit(1), F.lit(40)), F.lit(False)
        for o in lexicon.OPENERS:
            found = found | F.startswith(head, F.lit(o)) | F.contains(near, F.lit(o))
        return found

    hits = F.size(F.filter(checked, hit))
    return F.when(k == 0, 0.0).otherwise(M.clamp(hits / F.greatest(F.lit(2.0), F.size(checked) / 3.0)))


def triple_reuse(n: Column) -> Column:
    """Of counted rows: how many of a document's runs of three words repeat another; n are its words."""
    k = F.greatest(F.lit(0), n - 2)
    return F.when(k < 12, 0.0).otherwise(M.clamp((k - F.col("word_counts.triples")) / k * 4.0))


def bigram_entropy(n: Column) -> Column:
    """Of counted rows: the entropy of a document's runs of two words."""
    return F.when(n > 1, F.col("word_counts.pair_entropy")).otherwise(0.0)


def punctuation(d: DataFrame) -> DataFrame:
    """parsed rows with punctuation_uniformity."""
    marks = F.regexp_extract_all("raw", F.lit(r"[,.;:!?—\-]"), F.lit(0))
    d = d.withColumn("__marks", marks).withColumn("__m", runs("__marks", "string"))
    even = F.col("__m.entropy") / F.log(F.greatest(F.lit(2), F.col("__m.types")).cast("double"))
    return d.withColumn("punctuation_uniformity", F.when(F.size("__marks") < 8, 0.3).otherwise(M.inv_logistic(even, 0.55, 5.0))).drop("__marks", "__m")


def function_word_ratio(lowers: Column) -> Column:
    return _ratio(F.size(F.filter(lowers, lambda w: w.isin(*lexicon.FUNCTION_WORDS))), F.size(lowers))


def function_word_fit(lowers: Column) -> Column:
    """How close the shares of common function words are to those expected, and whether rare ones are missing."""
    n = F.size(lowers)

    def fit(few: Column) -> Column:
        close = F.lit(0.0)
        for word, share in lexicon.EXPECTED_SHARE.items():
            seen = (F.size(few) - F.size(F.array_remove(few, word))) / n
            close = close + 1 - F.least(F.lit(1.0), F.abs(seen - share) / (share + 1e-6))
        missing = sum((~F.array_contains(few, w)).cast("int") for w in lexicon.RARE_FUNCTION_WORDS)
        return M.clamp(0.75 * close / len(lexicon.EXPECTED_SHARE) + 0.25 * missing / len(lexicon.RARE_FUNCTION_WORDS))

    # The few words that count are taken out once.
    few = F.filter(lowers, lambda w: w.isin(*lexicon.EXPECTED_SHARE, *lexicon.RARE_FUNCTION_WORDS))
    return F.when(n > 0, T.let(few, fit)).otherwise(0.0)


def start_diversity(sent_words: Column) -> Column:
    starts = F.transform(F.filter(sent_words, lambda s: F.size(s) > 0), lambda s: s[0])
    return _ratio(F.size(F.array_distinct(starts)), F.size(starts))


def adjacent_similarity(sent_words: Column) -> Column:
    """The mean Jaccard similarity of the words of neighbouring sentences."""
    k = F.size(sent_words)

    def pair(a: Column, b: Column) -> Column:
        both = F.size(F.array_union(a, b))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)

    pairs = F.zip_with(F.slice(sent_words, 1, F.greatest(k - 1, F.lit(0))), F.slice(sent_words, 2, F.greatest(k - 1, F.lit(0))), pair)
    return F.when(k < 2, 0.0).otherwise(M.mean(pairs))


def style_ratios(d: DataFrame) -> DataFrame:
    """parsed rows with comma_ratio, contraction_ratio, digit_ratio, quote_count, avg_syllables, mean_wl."""
    d, n = counted(d), F.greatest(F.lit(1), F.col("n"))
    count = lambda c: F.regexp_count("raw", F.lit(c))
    return (
        d.withColumn("comma_ratio", F.size(F.filter("toks", lambda t: t == ",")) / n)
        .withColumn("contraction_ratio", F.col("word_counts.contractions") / n)
        .withColumn("digit_ratio", F.size(F.filter("toks", lambda t: t.rlike(r"^\p{Nd}"))) / F.greatest(F.lit(1), F.size("toks")))
        .withColumn("quote_count", count('"') + count("“") + count("’s"))
        .withColumn("avg_syllables", F.col("word_counts.syllables") / n)
        .withColumn("mean_wl", F.col("word_counts.letters") / n)
    )


def green(prev: Column, tok: Column, seed: int) -> Column:
    """Whether a word falls into the half of the vocabulary that seed and the word before it select."""
    return (M.keyed_hash([prev, tok, F.lit("g")], seed) % 10_000 < 5_000).cast("int")


#: Pairs of words whose hashes a scan keeps, besides those of the document that it is at.
KEPT_PAIRS = 200_000


_arrays = [StructField(c, ArrayType(IntegerType())) for c in ("hits", "first", "second")]


@F.arrow_udf(StructType([*_arrays, StructField("pairs", IntegerType()), StructField("steady", DoubleType())]))
def scan(lowers: pa.Array) -> pa.Array:
    """By seed, how many words of a document but the first are green; for the first two seeds, which ones are. Beside
    them the pairs of words that go on twice at least, and the sum of their commonest next words' shares.

    The same hash as green(), for arrays of words: a document's millions of hashes are made by a loop in an Arrow
    batch, since lambdas over arrays are not compiled in the JVM. Equal pairs of words are hashed once.
    """
    seeds = [f"{s}\x1f".encode() for s in lexicon.GREEN_SEEDS]
    bits, known = np.arange(len(seeds)), {}

    def learn(pairs: list[tuple[str, str]]) -> None:
        """Masks of the seeds by which the second word of a pair is green."""
        tails = [f"{a}\x1f{b}\x1fg".encode() for a, b in pairs]
        digests = b"".join([md5(s + t).digest() for t in tails for s in seeds])
        green = (np.frombuffer(digests, ">u4")[::4] >> 4) % 10_000 < 5_000
        known.update(zip(pairs, (green.reshape(-1, len(seeds)) @ (1 << bits)).tolist(), strict=True))

    out = []
    for words in lists(lowers):
        pairs = [*zip(words, words[1:])]  # noqa: B905
        if len(known) > KEPT_PAIRS:
            known.clear()
        fresh = [*{p for p in pairs if p not in known}]
        for at in range(0, len(fresh), 10_000):
            learn(fresh[at : at + 10_000])
        masks = [*map(known.__getitem__, pairs)]
        m = np.array(masks, np.int32)
        before, top = Counter(zip(words, words[1:-1])), {}  # noqa: B905
        for (x, y, _), n in Counter(zip(words, words[1:], words[2:])).items():  # noqa: B905
            if before[x, y] > 1 and n > top.get((x, y), 0):
                top[x, y] = n
        out.append(((m[:, None] >> bits & 1).sum(0, dtype=np.int32), m & 1, m >> 1 & 1, len(top), sum(n / before[p] for p, n in top.items())))
    columns = [*zip(*out, strict=True)] if out else [[]] * 5
    kinds = [*[pa.list_(pa.int32())] * 3, pa.int32(), pa.float64()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hits", "first", "second", "pairs", "steady"])


def scanned(d: DataFrame) -> DataFrame:
    """parsed rows with scan, which the watermark features share."""
    return d if "scan" in d.columns else d.withColumn("scan", scan("lowers"))


def z_score(hits: Column, n: Column) -> Column:
    return (hits / n - 0.5) / F.sqrt(0.25 / n)


def multiseed_scan(d: DataFrame) -> DataFrame:
    """parsed rows with max_z, mean_abs_z, z_std, mean_rate, max_rate, best_seed (the first of the largest z).

    A seed's z of h hits in k is t / sqrt(k) with t = 2 h - k; sums are of whole numbers, so their order is no matter.
    """
    k, seeds = F.greatest(F.lit(1), F.col("n") - 1).cast("long"), F.array(*map(F.lit, lexicon.GREEN_SEEDS))
    add, m, root = lambda a, x: a + x, len(lexicon.GREEN_SEEDS), F.sqrt(F.col("__k").cast("double"))
    d = scanned(d).withColumn("__k", k).withColumn("__t", F.transform("scan.hits", lambda h: 2 * h.cast("long") - F.col("__k")))
    d = (
        d.withColumn("__s", F.aggregate("__t", F.lit(0).cast("long"), add))
        .withColumn("__a", F.aggregate(F.transform("__t", F.abs), F.lit(0).cast("long"), add))
        .withColumn("__q", F.aggregate(F.transform("__t", lambda t: t * t), F.lit(0).cast("long"), add))
    )
    return (
        d.withColumn("max_z", F.array_max("__t") / root).withColumn("mean_abs_z", F.col("__a") / (m * root))
        .withColumn("z_std", F.sqrt((m * F.col("__q") - F.col("__s") * F.col("__s")) / (m * (m - 1) * F.col("__k")).cast("double")))
        .withColumn("mean_rate", (F.col("__s") + m * F.col("__k")) / (2 * m * F.col("__k"))).withColumn("max_rate", F.array_max("scan.hits") / F.col("__k"))
        .withColumn("best_seed", F.get(seeds, (F.array_position("__t", F.array_max("__t")) - 1).cast("int")))
        .drop("__k", "__t", "__s", "__a", "__q")
    )


def context_consistency(d: DataFrame) -> DataFrame:
    """parsed rows with context_consistency: how often word pairs go on with their commonest next word."""
    d = scanned(d)
    value = M.clamp((F.col("scan.steady") / F.greatest(F.lit(1), F.col("scan.pairs")) - 0.35) / 0.5)
    return d.withColumn("context_consistency", F.when(F.col("n") < 24, 0.0).when(F.col("scan.pairs") < 4, 0.15).otherwise(value))


def _window_hits(green_col: str, window: int, stride: int) -> Column:
    """Structs of start, m (words) and hits for each window; a window's first word has no predecessor in it."""
    size = lambda s: F.least(F.lit(window), F.col("n") - s)
    add = lambda a, x: a + x
    return T.let(
        F.col(green_col),
        lambda g: F.transform(
            T.window_starts(F.col("n"), window, stride),
            lambda s: F.struct(
                s.alias("start"), size(s).alias("m"), F.aggregate(F.slice(g, s + 1, F.greatest(F.lit(0), size(s) - 1)), F.lit(0), add).alias("hits")
            ),
        ),
    )


def window_spike(d: DataFrame, window: int = 48) -> DataFrame:
    """parsed rows with window_spike: how far the greenest or least green window stands out."""
    d = scanned(d).withColumn("__g", F.col("scan.first"))
    rates = F.transform(F.filter(_window_hits("__g", window, window // 2), lambda w: w["m"] >= 8), lambda w: w["hits"] / F.greatest(F.lit(1), w["m"] - 1))
    d = d.withColumn("__w", F.when(F.col("n") >= window, rates).otherwise(F.array().cast("array<double>")))
    d = d.withColumn("__m", M.mean(F.col("__w"))).withColumn("__s", M.sample_std(F.col("__w"), F.col("__m")))
    peak = F.array_max(F.transform("__w", lambda r: F.abs(r - F.col("__m")))) / F.col("__s")
    spike = F.when((F.size("__w") < 2) | (F.col("__s") <= 1e-9), 0.0).otherwise(M.clamp((peak - 1.1) / 3.0))
    return d.withColumn("window_spike", spike).drop("__g", "__w", "__m", "__s")


def rare_alignment(d: DataFrame, common: list[str]) -> DataFrame:
    """parsed rows with rare_alignment: how much greener words outside `common` are. Each class needs six words."""
    d = scanned(d).withColumn("__g", F.col("scan.second"))
    flags = F.zip_with(F.slice("lowers", 2, F.greatest(F.col("n") - 1, F.lit(0))), F.col("__g"), lambda t, g: F.struct((~t.isin(*common) if common else F.lit(True)).alias("rare"), g.alias("g")))
    d = d.withColumn(
        "__f",
        F.aggregate(
            flags,
            F.struct(*[F.lit(0).alias(x) for x in ("rn", "rg", "cn", "cg")]),
            lambda a, x: F.struct(
                (a["rn"] + F.when(x["rare"], 1).otherwise(0)).alias("rn"), (a["rg"] + F.when(x["rare"], x["g"]).otherwise(0)).alias("rg"),
                (a["cn"] + F.when(x["rare"], 0).otherwise(1)).alias("cn"), (a["cg"] + F.when(x["rare"], 0).otherwise(x["g"])).alias("cg"),
            ),
        ),
    )
    f = F.col("__f")
    delta = F.try_divide(f["rg"], f["rn"]) - F.try_divide(f["cg"], f["cn"])
    few = (F.col("n") < 24) | (f["rn"] < 6) | (f["cn"] < 6)
    return d.withColumn("rare_alignment", F.when(few, 0.0).otherwise(M.clamp(delta / 0.25))).drop("__g", "__f")


def hot_spans(d: DataFrame, window: int = 80, most: int = 12) -> DataFrame:
    """parsed rows with hot_spans: of the windows with a green z of 1.6 or more, the first `most`."""
    d = scanned(d).withColumn("__g", F.col("scan.first"))
    spans = F.transform(
        _window_hits("__g", window, window // 2),
        lambda w: F.struct(w["start"].alias("start"), (w["start"] + w["m"]).alias("end"), z_score(w["hits"], F.greatest(F.lit(1), w["m"] - 1).cast("double")).alias("z")),
    )
    hot = F.transform(F.filter(spans, lambda s: s["z"] >= 1.6), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), M.clamp((s["z"] - 1) / 4).alias("score")))
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    return d.withColumn("hot_spans", F.when(F.col("n") >= window, F.slice(hot, 1, most)).otherwise(none)).drop("__g")


def confidence(n: Column, base: float, gain: float, least: int) -> Column:
    return M.clamp(base + gain * F.log(10.0, F.greatest(n, F.lit(least)).cast("double")) / 3.0)


