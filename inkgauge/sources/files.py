"""Files in and out, through Spark's readers and writers alone."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that a directory scan takes, and the largest file that is read as bytes.
SUFFIXES = ("md", "markdown", "txt", "html", "htm", "rst", "org")
MEDIA_SUFFIXES = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "pdf")
MOST_BYTES = 50 * 1024 * 1024
#: Names of image and PDF files, in any case.
MEDIA_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in MEDIA_SUFFIXES) + "}"


def read_texts(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] | None = SUFFIXES) -> DataFrame:
    """path, text of whole files; directories are read with what lies below them, by suffix."""
    glob = "*.{" + ",".join(suffixes) + "}" if suffixes else None
    rows = spark.read.text(list(paths), wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, *paths: str, most: int = MOST_BYTES, glob: str | None = None) -> DataFrame:
    """path, length, content of files; content is null, and error told, over `most` bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(list(paths))
    small = F.col("length") <= most
    return files.select("path", "length", F.when(small, F.col("content")).alias("content"), F.when(~small, F.concat(F.lit("larger than "), F.lit(most), F.lit(" bytes"))).alias("error"))


def read_documents(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = SUFFIXES, most: int = MOST_BYTES) -> DataFrame:
    """path, text, error of files by suffix: one that is too large or isn't UTF-8 has an error and no text, and stops nothing else.

    Spark leaves files without a byte out of its scans.
    """
    rows = read_bytes(spark, *paths, most=most, glob="*.{" + ",".join(suffixes) + "}")
    bad = F.col("content").isNotNull() & ~F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select(
        "path", F.when(~bad, F.col("content").cast("string")).alias("text"), F.coalesce("error", F.when(bad, "not UTF-8")).alias("error")
    )


#: What a Parquet file holds in one piece, by the usual settings of its writers.
ROW_GROUP_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where its files are fewer than these and too small to hold a piece for each; else df as it is.

    A file is only read by as many tasks as it has row groups, into however many splits it is cut. So what is dealt
    anew is never more than a row group's size for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if len(df.inputFiles()) < cores and size < cores * ROW_GROUP_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="inkgauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def as_json(df: DataFrame) -> DataFrame:
    """json: each row as an object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_batch(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows by Spark's commit protocol: a failed job leaves nothing half written."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def output_name(path: Column, suffix: str) -> Column:
    """A name for a file's result that keeps its own suffix, so that a.md and a.txt don't meet."""
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit(suffix))


def markdown_report(summary: DataFrame, title: str, most: int = 200) -> str:
    """A table of a small summary's first rows, as Markdown."""
    rows = summary.limit(most).collect()
    head = f"| {' | '.join(summary.columns)} |\n|{'---|' * len(summary.columns)}"
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", head, *(f"| {' | '.join(map(cell, r))} |" for r in rows), ""])
