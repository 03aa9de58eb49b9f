"""Scoring a stream: the detectors are projections of a row, so a stream of texts needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.detectors import detect


def read_documents(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def score_stream(docs: DataFrame, ranks: dict[str, int]) -> DataFrame:
    return detect(docs, ranks).select("doc_id", "ensemble_score", "ensemble_confidence", "label")


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and users by window and type; later ones than the watermark allows are left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "users", "value")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """What there is now, into Parquet; a restart goes on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
