"""Incremental loads: a file stream, repeated keys dropped within a watermark, latest row of each key kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import latest


def stream_table(spark: SparkSession, folder: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def distinct_stream(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the delay; state is dropped after it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by window and group; late ones count within the delay."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", by, "n")


def load_latest(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Each batch is appended under its number, so a repeated batch replaces itself; ``read_latest`` reads the result."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, F.col(version).desc()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    return latest(spark.read.parquet(path), keys, F.col(version).desc(), F.col("batch").desc()).drop("batch")
