"""What several operators here need: shared scratch tables and whole-number ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_RUN = uuid.uuid4().hex[:12]


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inkgauge-{_RUN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def global_rank(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df, written, with rank: its rows' place from 0 in the order of `by`.

    Rows are dealt by range, counted by partition, and numbered within each; only the counts, one for each
    partition, come to the driver.
    """
    spark = df.sparkSession
    dealt = written(
        df.repartitionByRange(*by).withColumn("__pid", F.spark_partition_id()), name
    )
    counts = sorted((r["__pid"], r["n"]) for r in dealt.groupBy("__pid").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for pid, n in counts:
        starts.append((pid, total))
        total += n
    offsets = spark.createDataFrame(starts, "__pid int, __start long")
    within = F.row_number().over(Window.partitionBy("__pid").orderBy(*by)).cast("long")
    return (
        dealt.join(F.broadcast(offsets), "__pid")  # one row for each partition
        .withColumn("rank", F.col("__start") + within - 1)
        .drop("__pid", "__start")
    )


#: A side is broadcast up to so many rows, and only when it is written and counted; beyond it is dealt by salted keys.
BROADCAST_ROWS = 100_000
SALTS = 32


def merged_if_large(table: DataFrame, rows: int | None = None) -> DataFrame:
    """table (written, unless its rows are told), which joins don't broadcast if it has more than BROADCAST_ROWS, however small its file."""
    return table if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table.hint("merge")


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """big joined with a side that is usually small and has one narrow row for each key; no key makes a hot task.

    small is written and counted: up to max_rows it is broadcast. Beyond that each of its rows is repeated for
    every salt and the rows of big are spread over the salts, so that a key with a third of all rows is split. These are
    merged: Spark estimates them by their compressed file and not by the salts, and would broadcast millions of rows.
    Null keys match nulls.
    """
    small = written(small, "side")
    own = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    drop = [f"__k{i}" for i in range(len(keys))]
    if small.count() <= max_rows:
        return big.join(F.broadcast(own), on, how).drop(*drop)
    salted = own.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return spread.join(salted.hint("merge"), [*on, F.col("__salt") == F.col("__s")], how).drop(*drop, "__s", "__salt")
