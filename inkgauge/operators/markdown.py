"""Markdown: lines to segments that are prose or protected, as gaps and islands over a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

REWRITEABLE = ("prose", "list_item", "blockquote")


def lines(c: Column) -> Column:
    """Lines with their ends. A mark is put behind each end and split at; U+0001 is no line end."""
    marked = F.regexp_replace(c, f"({T.LINE_END})", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def line_kind(line: Column, protect_tables: bool = True) -> Column:
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    table = bare.rlike(r"^\s*\|.+\|\s*$") | bare.rlike(r"^\s*(?:[-*_]\s*){3,}$")
    return (
        F.when(bare.rlike(r"^\s*$"), "prose")
        .when(bare.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(bare.rlike(r"^\s*(?:[-*+]|\d+\.)\s+"), "list_item")
        .when(bare.rlike(r"^\s*>"), "blockquote")
        .when(table & F.lit(protect_tables), "table")
        .when(bare.rlike(r"^\s*</?[A-Za-z][^>]*>"), "html")
        .otherwise("prose")
    )


def segments(docs: DataFrame, id_col: str = "doc_id", text: str = "text", protect_tables: bool = True) -> DataFrame:
    """id, seg (from 0), kind, protected, text. Front matter runs from a first line `---` to the next one, or to the end.

    A fence line switches code on and off; the windows run within a document.
    """
    w = Window.partitionBy(id_col).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.select(id_col, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("line", "t"))
    bare = F.regexp_replace("t", r"[\r\n]+$", "")
    rule = bare.rlike(r"^---\s*$")
    rows = rows.withColumn("rule", rule)
    opened = F.max(F.when((F.col("line") == 0) & F.col("rule"), 1).otherwise(0)).over(w)
    closed = F.coalesce(F.sum(F.when((F.col("line") > 0) & F.col("rule"), 1).otherwise(0)).over(upto), F.lit(0))
    rows = rows.withColumn("front", (opened == 1) & (closed == 0))
    rows = rows.withColumn("fence", bare.rlike(r"^ {0,3}(?:`{3}|~{3})") & ~F.col("front"))
    before = F.coalesce(F.sum(F.col("fence").cast("int")).over(upto), F.lit(0)) % 2
    kind = F.when(F.col("front"), "frontmatter").when(F.col("fence") | (before == 1), "code").otherwise(line_kind(F.col("t"), protect_tables))
    rows = rows.withColumn("kind", kind)
    fresh = F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("fresh", fresh).withColumn("seg", F.sum("fresh").over(w).cast("int"))
    return rows.groupBy(id_col, "seg").agg(
        F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "").alias("text")
    ).select(id_col, "seg", "kind", (~F.col("kind").isin(*REWRITEABLE)).alias("protected"), "text")


def rewriteable(segs: DataFrame) -> DataFrame:
    return segs.where(~F.col("protected") & F.col("kind").isin(*REWRITEABLE) & (T.strip(F.col("text")) != ""))


def rendered(segs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, text: the segments put together again."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"])
    return segs.groupBy(id_col).agg(F.array_join(parts, "").alias("text"))


def prose_only(docs: DataFrame, id_col: str = "doc_id", text: str = "text", protect_tables: bool = True) -> DataFrame:
    """docs' ids with the text that is scored: the prose, or the whole text where there is none."""
    prose = rendered(rewriteable(segments(docs, id_col, text, protect_tables)), id_col).withColumnRenamed("text", "prose")
    return docs.join(prose, id_col, "left").select(id_col, F.coalesce("prose", F.col(text)).alias("text"))


def keep_outer_space(original: Column, new: Column) -> Column:
    """new within the white space that surrounds original."""
    lead = F.regexp_extract(original, rf"^[{T.SPACE}]*", 0)
    trail = F.regexp_extract(original, rf"[{T.SPACE}]*$", 0)
    return F.when(T.strip(original) == "", original).otherwise(F.concat(lead, T.strip(new), trail))
