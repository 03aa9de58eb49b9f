"""Detection as a job: clean texts, score their prose, compare before and after, and tell it in a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..lexicon import word_ranks
from ..sources.files import markdown_report, output_name, read_documents, write_batch
from .detectors import collected_ranks, detect
from .markdown import prose_only
from .pairs import compare


def detect_documents(docs: DataFrame, ranks: dict[str, int], settings: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:  # noqa: B008
    """The detectors over each document's prose, without control characters; a document without prose is scored whole."""
    clean = docs.select(id_col, T.sanitize(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return detect(prose_only(clean, id_col, protect_tables=settings.protect_tables), ranks, settings)


def evaluate(pairs: DataFrame, ranks: dict[str, int], settings: Settings = Settings(), id_col: str = "pair_id") -> DataFrame:  # noqa: B008
    """pairs(pair_id, original, rewritten) -> before, after, delta (ensemble scores), labels, what compare() gives, and
    target_met: the gate is passed and the score after is low enough.

    Both sides are rows of one scoring pass, told apart by a column, and meet again by the pair. Equal sides are one row.
    """
    before, after, same = [F.struct(F.lit(name).alias("side"), F.col(c).alias("text")) for c, name in (("original", "before"), ("rewritten", "after"), ("original", "same"))]
    sides = F.when(F.col("original").eqNullSafe(F.col("rewritten")), F.array(same)).otherwise(F.array(before, after))
    scored = detect(pairs.select(id_col, F.explode(sides).alias("s")).select(id_col, "s.*"), ranks, settings)
    one = lambda name, c: F.max(F.when(F.col("side").isin(name, "same"), F.col(c)))
    both = scored.groupBy(id_col).agg(
        *[one(name, "ensemble_score").alias(name) for name in ("before", "after")], *[one(name, "label").alias(f"{name}_label") for name in ("before", "after")],
    ).withColumn("delta", F.col("after") - F.col("before"))
    out = both.join(compare(pairs, settings, id_col), id_col)
    return out.withColumn("target_met", F.col("passed") & (F.col("after") <= settings.quality.target_ai_score))


def comparison_report(evaluated: DataFrame, title: str = "Before and after", most: int = 200) -> str:
    """A report on evaluate()'s rows: what holds for all of them, then a table of the first `most` pairs."""
    total = evaluated.agg(
        F.count("*").alias("pairs"), F.avg("before").alias("before"), F.avg("after").alias("after"), F.avg("similarity").alias("similarity"),
        F.avg("token_change_rate").alias("change"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(F.col("target_met"), 1)).alias("target met"),
    )
    id_col = evaluated.columns[0]
    shown = evaluated.orderBy(id_col).select(
        id_col, "before", "before_label", "after", "after_label", "delta", "similarity", "token_change_rate", "readability_before", "readability_after",
        "passed", F.array_join("reasons", ", ").alias("reasons"), "target_met",
    )
    return markdown_report(total, title) + "\n" + markdown_report(shown, "Pairs", most)


def corpus_summary(scored: DataFrame, *by: str) -> DataFrame:
    """Documents, mean score and labels by columns; one row for each group is all that moves."""
    count = lambda label: F.count(F.when(F.col("label") == label, 1)).alias(label)
    return scored.groupBy(*by).agg(
        F.count("*").alias("docs"), F.avg("ensemble_score").alias("mean_score"), F.expr("percentile_approx(ensemble_score, 0.9)").alias("p90"),
        *map(count, ("human", "uncertain", "ai", "watermarked")),
    )


def report(scored: DataFrame, *by: str, title: str = "Detection") -> str:
    return markdown_report(corpus_summary(scored, *by).orderBy(*by), title)


def detect_batch(spark: SparkSession, source: str | list[str], dest: str, ranks: dict[str, int] | None = None, settings: Settings = Settings(), suffix: str = ".score") -> tuple[int, int]:  # noqa: B008
    """Scores the files below source into dest: a row for each, with its result's name, its score or its error.

    A file that can't be read as text fails alone. Returns the files that were scored and those that failed. Without
    ranks the files' own words are ranked.
    """
    files = read_documents(spark, *([source] if isinstance(source, str) else source))
    docs = files.where("error is null").select(F.col("path").alias("doc_id"), "text")
    if ranks is None:
        ranks = collected_ranks(word_ranks(docs.select(F.explode(T.lower_words(F.col("text"))).alias("tok"))))
    scored = detect_documents(docs, ranks, settings).select(
        F.col("doc_id").alias("path"), output_name(F.col("doc_id"), suffix).alias("name"), "ensemble_score", "ensemble_confidence", "label", F.lit(None).cast("string").alias("error"),
    )
    failed = files.where("error is not null").select("path", output_name(F.col("path"), suffix).alias("name"), "error")
    write_batch(scored.unionByName(failed, allowMissingColumns=True), dest)
    done = spark.read.parquet(dest).agg(F.count(F.when(F.col("error").isNull(), 1)).alias("ok"), F.count("error").alias("bad")).first()
    return done["ok"], done["bad"]
