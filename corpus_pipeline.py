"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of
documents; run() writes each result and reads it again as the next one's docs. SQL can't express the toxicity model, the
tokenizer or the seeded choice, so there is no ORACLE_SQL; tests/llm holds the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm._shared import join_small, written
from inkgauge.llm.line_dedup import drop_site_lines
from inkgauge.llm.mixing import mix, repeated
from inkgauge.llm.ngram_join import jaccard_components
from inkgauge.llm.packing import pack
from inkgauge.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from these documents' labels, doesn't call toxic.

    Null and empty texts are scored as texts without windows; rows alike are judged alike; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, fit(docs, labels)).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over a tenth of their source's documents hold; a source is a site.

    A null source is a site; null texts stay null and hold no lines; a document that loses lines has its characters
    counted anew; one of which nothing is left stays, empty; repeated rows count as documents of their own.
    """
    kept = drop_site_lines(docs.select(*COLUMNS), F.col("source"), F.col("text"))
    return kept.select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id.

    Of rows of one id the first by text (null last), language, source and characters stays. Texts without words are
    linked with nothing and stay, as do rows without an id.
    """
    docs = docs.select(*COLUMNS)
    found = written(jaccard_components(docs).select("doc_id", "component_id"), "components")
    gone = found.where("doc_id != component_id").select("doc_id").distinct().withColumn("__gone", F.lit(True))
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("__twice"))
    left = join_small(join_small(docs, gone, ["doc_id"]).where("__gone is null"), twice, ["doc_id"])
    once = left.where("__twice is null").select(*COLUMNS)
    # Partial minima: however often an id is repeated, one row of it leaves a task.
    order = F.struct(F.col("text").isNull().alias("none"), *COLUMNS[1:])
    first = left.where("__twice").groupBy("doc_id").agg(F.min(order).alias("r")).select("doc_id", *[F.col(f"r.{c}") for c in COLUMNS[1:]])
    return once.unionByName(first)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are never taken. A null source is a source, the last."""
    return repeated(mix(docs.select(*COLUMNS)), COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the mix, with a digest of their ids. Null text is empty; each repetition of a row has its own sequences."""
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
