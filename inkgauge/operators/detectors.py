"""Detectors: features to score, confidence, label, signals and spans; and the ensemble over them.

All are projections of one row: a corpus is scored without a shuffle. The list of ranked words, which perplexity and
rare-word alignment take, is a parameter; its rows are few and become literals.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..config import Settings
from ..functions import features as X
from ..functions import maths as M
from ..functions import measures
from ..functions import text as T

SIGNAL = "array<struct<name:string,value:double,weight:double>>"


def label(score: Column, family: str | Column, settings: Settings = Settings()) -> Column:  # noqa: B008
    d = settings.detect
    marked = F.lit(family == "watermark") if isinstance(family, str) else family == "watermark"
    return (
        F.when(marked & (score >= d.watermark_likely), "watermarked")
        .when(~marked & (score >= d.ai_likely), "ai")
        .when(score >= d.uncertain, "uncertain")
        .otherwise("human")
    )


def signals(**named: tuple[Column, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value"), F.lit(w).alias("weight")) for k, (v, w) in named.items()])


def _slots(words: list[str]) -> tuple[int, list[int]]:
    """A table size at which the words' hashes fall into different slots, and these slots."""
    hashes = [(h := xxhash.xxh64_intdigest(w.encode(), 42)) - (h >> 63 << 64) for w in words]
    size = 1 << 10
    while len({h % size for h in hashes}) < len(hashes):
        size += (size >> 3) + 1
    return size, [h % size for h in hashes]


def _mean_surprisal(lowers: Column, ranks: dict[str, int]) -> Column:
    """The mean over words: unlisted ones have one value, each listed one its rank's.

    A listed word's value is found by its hash: the words lie in a table in which no two of them meet.
    """
    n, listed, known = F.size(lowers), F.lit(0.0), F.array().cast("array<string>")
    if ranks:
        size, slots = _slots(list(ranks))
        table = [0.0] * size
        for slot, rank in zip(slots, ranks.values(), strict=True):
            table[slot] = math.log((rank + 2) * math.log(M.VOCABULARY + 1))
        values = F.expr(f"array({', '.join(f'{v!r}D' for v in table)})")
        known = F.filter(lowers, lambda w: w.isin(*ranks))
        listed = F.aggregate(known, F.lit(0.0), lambda a, w: a + F.get(values, F.pmod(F.xxhash64(w), F.lit(size)).cast("int")))
    unlisted = (n - F.size(known)) * M.surprisal(F.lit(None).cast("int"))
    return F.when(n > 0, (listed + unlisted) / n).otherwise(0.0)


def perplexity(lowers: Column, ranks: dict[str, int]) -> Column:
    return F.when(F.size(lowers) > 0, F.least(F.exp(F.least(_mean_surprisal(lowers, ranks), F.lit(20.0))), F.lit(1e6))).otherwise(0.0)


def collected_ranks(ranks: DataFrame) -> dict[str, int]:
    """A list of ranked words (a few hundred rows by its definition) on the driver."""
    return {r["word"]: r["rank"] for r in ranks.orderBy("rank").collect()}


def classical_features(d: DataFrame, ranks: dict[str, int]) -> DataFrame:
    d = X.punctuation(X.sentence_lengths(X.richness(d)))
    return (
        d.withColumn("perplexity", perplexity(F.col("lowers"), ranks))
        .withColumn("phrase_density", X.phrase_density(F.col("raw"), F.col("n")))
        .withColumn("opener_score", X.opener_score(F.col("sents")))
        .withColumn("ngram_reuse", X.triple_reuse(F.col("n")))
        .withColumn("function_word_ratio", X.function_word_ratio(F.col("lowers")))
    )


def classical(d: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """parsed rows with classical_features and classical_score, classical_confidence."""
    return classical_score(classical_features(d, ranks))


def classical_score(d: DataFrame) -> DataFrame:
    c, inv = F.col, M.inv_logistic
    mix = (
        0.14 * inv(c("perplexity"), 80, 0.04) + 0.12 * inv(c("burstiness"), 0.55, 5) + 0.08 * inv(c("ttr"), 0.52, 8)
        + 0.04 * inv(c("hapax"), 0.45, 6) + 0.30 * c("phrase_density") + 0.12 * c("opener_score") + 0.08 * c("length_uniformity")
        + 0.06 * c("ngram_reuse") + 0.04 * c("punctuation_uniformity") + 0.02 * M.logistic(c("function_word_ratio"), 0.45, 10)
    )
    mix = F.when(c("phrase_density") >= 0.55, F.greatest(mix, 0.52 + 0.40 * c("phrase_density"))).otherwise(mix)
    conf = X.confidence(c("n"), 0.35, 0.45, 10) * F.when(c("n") < 80, 0.7).otherwise(1.0)
    short = c("n") < 12
    return d.withColumn("classical_score", F.when(short, 0.0).otherwise(M.clamp(mix))).withColumn("classical_confidence", F.when(short, 0.0).otherwise(M.clamp(conf)))


def stylometric_features(d: DataFrame) -> DataFrame:
    d = X.style_ratios(X.sentence_lengths(X.richness(d)))
    return (
        d.withColumn("function_word_fit", X.function_word_fit(F.col("lowers")))
        .withColumn("start_diversity", X.start_diversity(F.col("sent_words")))
        .withColumn("bigram_entropy", X.bigram_entropy(F.col("n")))
        .withColumn("adjacent_similarity", X.adjacent_similarity(F.col("sent_words")))
    )


def stylometric(d: DataFrame) -> DataFrame:
    """parsed rows with stylometric_features and stylometric_score, stylometric_confidence."""
    return stylometric_score(stylometric_features(d))


def stylometric_score(d: DataFrame) -> DataFrame:
    c, inv, log, band = F.col, M.inv_logistic, M.logistic, M.target_band
    mix = (
        0.10 * inv(c("ttr"), 0.55, 8) + 0.08 * log(c("yules_k"), 120, 0.03) + 0.05 * inv(c("honores_r"), 800, 0.004)
        + 0.08 * band(c("mean_sl"), 16.0, 24.0) + 0.10 * inv(c("std_sl"), 6.5, 0.25) + 0.10 * log(c("function_word_fit"), 0.55, 6)
        + 0.10 * inv(c("contraction_ratio"), 0.025, 40) + 0.10 * inv(c("start_diversity"), 0.62, 6)
        + 0.10 * log(c("adjacent_similarity"), 0.28, 8) + 0.07 * inv(c("bigram_entropy"), 4.2, 1.2)
        + 0.04 * band(c("comma_ratio"), 0.04, 0.09) + 0.04 * band(c("avg_syllables"), 1.45, 1.75) + 0.04 * inv(c("hapax"), 0.48, 6)
    )
    short = c("n") < 12
    return d.withColumn("stylometric_score", F.when(short, 0.0).otherwise(M.clamp(mix))).withColumn(
        "stylometric_confidence", F.when(short, 0.0).otherwise(X.confidence(c("n"), 0.40, 0.40, 10))
    )


def statistical(d: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """parsed rows with the watermark heuristics and statistical_score, statistical_confidence, hot_spans."""
    common = [w for w, r in ranks.items() if r <= lexicon.COMMON_RANK]
    d = X.hot_spans(X.rare_alignment(X.window_spike(X.context_consistency(X.multiseed_scan(X.scanned(d)))), common))
    return statistical_score(d)


def statistical_score(d: DataFrame) -> DataFrame:
    c = F.col
    mix = (
        0.34 * M.clamp((c("max_z") - 1.2) / 4.0) + 0.12 * M.clamp(c("mean_abs_z") / 2.5) + 0.10 * M.clamp((c("z_std") - 0.4) / 1.6)
        + 0.22 * c("context_consistency") + 0.14 * c("window_spike") + 0.08 * c("rare_alignment")
    )
    short = c("n") < 16
    return d.withColumn("statistical_score", F.when(short, 0.0).otherwise(M.clamp(mix))).withColumn(
        "statistical_confidence", F.when(short, 0.0).otherwise(X.confidence(c("n"), 0.22, 0.35, 16))
    )


# A detector's family, and the columns its score is made of with the weights that are reported for them.
MEMBERS = {"classical": "classical", "stylometric": "stylometric", "statistical": "watermark"}
REPORTED = {
    "classical": {
        "perplexity": 0.22, "burstiness": 0.16, "ttr": 0.10, "hapax": 0.06, "phrase_density": 0.16, "opener_score": 0.08,
        "length_uniformity": 0.08, "ngram_reuse": 0.08, "punctuation_uniformity": 0.04, "function_word_ratio": 0.02,
    },
    "stylometric": {
        "ttr": 0.10, "yules_k": 0.08, "honores_r": 0.05, "mean_sl": 0.08, "std_sl": 0.10, "function_word_fit": 0.10,
        "contraction_ratio": 0.10, "start_diversity": 0.10, "adjacent_similarity": 0.10, "bigram_entropy": 0.07,
        "comma_ratio": 0.04, "avg_syllables": 0.04, "hapax": 0.04,
    },
    "statistical": {
        "max_z": 0.34, "mean_abs_z": 0.12, "z_std": 0.10, "context_consistency": 0.22, "window_spike": 0.14, "rare_alignment": 0.08,
    },
}


def ensemble(d: DataFrame, settings: Settings = Settings(), members: list[str] | None = None) -> DataFrame:  # noqa: B008
    """Rows with the members' scores -> also ensemble_score, ensemble_confidence, agreement, family, label, spans.

    Members without score and confidence don't vote if any other does.
    """
    names = members or list(settings.detect.detectors)
    score = {n: F.col(f"{n}_score") for n in names}
    conf = {n: F.col(f"{n}_confidence") for n in names}
    votes = {n: (score[n] > 0) | (conf[n] > 0) for n in names}
    any_vote = sum(v.cast("int") for v in votes.values()) > 0
    used = {n: (votes[n] | ~any_vote) for n in names}
    weight = {n: F.when(used[n], lexicon.FAMILY_WEIGHTS.get(MEMBERS.get(n, ""), 0.2) * F.greatest(F.lit(0.15), conf[n])).otherwise(0.0) for n in names}
    add = lambda xs: sum(xs, F.lit(0.0))
    total, k = F.col("__w"), F.col("__k")
    d = d.withColumn("__w", add(weight.values())).withColumn("__k", sum(used[n].cast("int") for n in names))
    d = d.withColumn("ensemble_score", add(score[n] * weight[n] for n in names) / total)
    d = d.withColumn("__m", add(F.when(used[n], score[n]).otherwise(0.0) for n in names) / k)
    var = add(F.when(used[n], (score[n] - F.col("__m")) * (score[n] - F.col("__m"))).otherwise(0.0) for n in names) / F.greatest(F.lit(1), k - 1)
    d = d.withColumn("agreement", F.greatest(F.lit(0.0), 1 - F.sqrt(var) / 0.35))
    d = d.withColumn("ensemble_confidence", M.clamp(0.7 * add(conf[n] * weight[n] for n in names) / total + 0.3 * F.col("agreement")))
    mark = family_score("watermark", names)
    forced = (mark >= settings.detect.watermark_likely) & (mark >= F.col("ensemble_score"))
    d = d.withColumn("family", F.when(forced, "watermark").otherwise("ensemble"))
    spans = promoted_spans(F.col("hot_spans")) if "hot_spans" in d.columns else F.array().cast("array<struct<start:int,end:int,score:double>>")
    return d.withColumn("label", label(F.col("ensemble_score"), F.col("family"), settings)).withColumn("spans", spans).drop("__w", "__k", "__m")


def family_score(family: str, names: list[str] | tuple[str, ...] = tuple(MEMBERS)) -> Column:
    """The mean of a family's members' scores, each rounded as it is reported; 0 without members."""
    own = [F.round(F.col(f"{n}_score"), 4) for n in names if MEMBERS.get(n) == family]
    return sum(own, F.lit(0.0)) / len(own) if own else F.lit(0.0)


def whole_text_span(text: Column, score: Column) -> Column:
    """A document's one score as a span over its text; none without tokens."""
    one = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), score.alias("score")))
    return F.when(F.size(T.tokens(text)) > 0, one).otherwise(F.array().cast("array<struct<start:int,end:int,score:double>>"))


def promoted_spans(spans: Column, most: int = 16) -> Column:
    """The strongest spans, ties in order."""
    numbered = F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("key"), i.alias("i"), s.alias("span")))
    return F.transform(F.slice(F.array_sort(numbered), 1, most), lambda x: x["span"])


def detect(docs: DataFrame, ranks: dict[str, int], settings: Settings = Settings(), text: str = "text") -> DataFrame:  # noqa: B008
    """All three detectors and the ensemble over docs.text; the features are measured in one pass over batches of texts."""
    d = measures.measured(docs, ranks, text, "statistical" in settings.detect.detectors)
    for name in settings.detect.detectors:
        d = {"classical": classical_score, "stylometric": stylometric_score, "statistical": statistical_score}[name](d)
    return ensemble(d, settings)


def result(name: str, settings: Settings = Settings()) -> Column:  # noqa: B008
    """A detector's columns as one record."""
    family = MEMBERS[name]
    s, c = F.col(f"{name}_score"), F.col(f"{name}_confidence")
    return F.struct(
        F.lit(name).alias("name"), F.lit(family).alias("family"), s.alias("score"), c.alias("confidence"),
        F.when(c == 0, "uncertain").otherwise(label(s, family, settings)).alias("label"),
        signals(**{k: (F.col(k), w) for k, w in REPORTED[name].items()}).alias("signals"),
    )


def detect_windows(docs: DataFrame, ranks: dict[str, int], settings: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:  # noqa: B008
    """A row for each token window of each document, with the ensemble's columns; a short text is one window.

    Windows are made within the row and scored by the same columns; nothing is shuffled.
    """
    size, stride = settings.detect.window_tokens, settings.detect.window_stride
    toks = T.tokens(F.coalesce(F.col("text"), F.lit("")))
    windows = docs.select(id_col, toks.alias("__t")).withColumn("__w", F.explode(T.window_starts(F.size("__t"), size, stride)))
    cut = windows.select(id_col, (F.col("__w") / stride).cast("int").alias("win"), F.array_join(F.slice("__t", F.col("__w") + 1, size), " ").alias("text"))
    return detect(cut, ranks, settings)
