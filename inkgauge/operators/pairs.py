"""Comparison of two texts in one row: overlap, cosines, change, and the quality gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import features as X
from ..functions import maths as M
from ..functions import measures


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of the sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def apart(d: DataFrame) -> DataFrame:
    """d, its columns laid down: no expression of theirs is written out again where later ones use it. Nothing leaves the JVM."""
    return d.select(F.explode(F.array(F.struct(*d.columns))).alias("__r")).select("__r.*")


def cosine(c: str = "") -> Column:
    """Of the columns of measures.comparison(), with prefix c."""
    norm = F.sqrt(F.col(f"{c}aa").cast("double")) * F.sqrt(F.col(f"{c}bb").cast("double"))
    return F.when(norm > 0, F.col(f"{c}dot") / norm).otherwise(0.0)


def change_rate(c: str = "") -> Column:
    """1 less the share of tokens that both have, of the longer side's."""
    most = F.greatest(f"{c}na", f"{c}nb")
    return F.when(F.col(f"{c}na") == 0, F.when(F.col(f"{c}nb") > 0, 1.0).otherwise(0.0)).otherwise(1 - F.col(f"{c}common") / F.greatest(most, F.lit(1)))


def compare(pairs: DataFrame, settings: Settings = Settings(), id_col: str = "pair_id") -> DataFrame:  # noqa: B008
    """pairs(pair_id, original, rewritten) -> similarity, method, word_cosine, char_cosine, unigram_jaccard, token_change_rate,
    readability_before and _after, length_ratio, original_tokens, rewritten_tokens, changed_tokens, reasons, passed.

    Where pairs also has original_vector and rewritten_vector, similarity is their cosine, and of n-grams only where one is null.
    A row's measures are made in the row: nothing is shuffled.
    """
    q, vectors = settings.quality, ["original_vector", "rewritten_vector"]
    given = [F.col(v).cast("array<double>").alias(v) if v in pairs.columns else F.lit(None).cast("array<double>").alias(v) for v in vectors]
    d = pairs.select(id_col, F.coalesce("original", F.lit("")).alias("original"), F.coalesce("rewritten", F.lit("")).alias("rewritten"), *given)
    d = d.withColumn("__c", measures.comparison("original", "rewritten"))
    out = d.select(
        id_col, X.reading_ease(F.col("__c.sents_a"), F.col("__c.na"), F.col("__c.syll_a")).alias("readability_before"),
        X.reading_ease(F.col("__c.sents_b"), F.col("__c.nb"), F.col("__c.syll_b")).alias("readability_after"),
        F.when(F.col("__c.either") == 0, 1.0).otherwise(F.col("__c.inter") / F.greatest("__c.either", F.lit(1))).alias("unigram_jaccard"),
        (F.length("rewritten") / F.greatest(F.lit(1), F.length("original"))).alias("length_ratio"), (F.col("__c.sents_b") == 0).alias("__blank"), *vectors, "__c.*",
    )
    out = apart(out)
    out = out.withColumn("word_cosine", cosine()).withColumn("char_cosine", cosine("g_")).withColumn("token_change_rate", change_rate())
    near = vector_cosine(*map(F.col, vectors))
    out = out.withColumn("similarity", F.coalesce(near, 0.55 * F.col("word_cosine") + 0.45 * F.col("char_cosine")))
    out = out.withColumn("method", F.when(near.isNull(), "ngrams").otherwise("embeddings"))
    harder = (F.col("readability_after") < q.min_readability) & (F.col("readability_after") + 15 < F.col("readability_before"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("similarity") < q.min_similarity, "similarity"), F.when(F.col("length_ratio") > q.max_length_ratio, "too long"),
            F.when(F.col("length_ratio") < q.min_length_ratio, "too short"), F.when(harder, "readability"), F.when(F.col("__blank"), "empty"),
        )
    )
    return (
        out.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
        .withColumn("changed_tokens", F.bround(F.col("token_change_rate") * F.greatest("na", "nb")).cast("long"))
        .select(
            id_col, "similarity", "method", "word_cosine", "char_cosine", "unigram_jaccard", "token_change_rate", "readability_before", "readability_after",
            "length_ratio", F.col("na").alias("original_tokens"), F.col("nb").alias("rewritten_tokens"), "changed_tokens", "reasons", "passed",
        )
    )


def dot(a: Column, b: Column) -> Column:
    return M.total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def vector_cosine(a: Column, b: Column) -> Column:
    """Null if either vector is; 0 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).when(norm.isNotNull(), 0.0)
