"""Writing tables, reports and run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Parquet, replacing what is there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def save_csv(df: DataFrame, path: str) -> str:
    """CSV with header; arrays as JSON."""
    flat = [F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def save_outputs(summary: DataFrame, details: DataFrame, stem: str) -> tuple[str, str]:
    """A summary and, beside it, its details."""
    return save_csv(summary, stem), save_csv(details, f"{stem}_details")


def save_report(df: DataFrame, path: str) -> str:
    """A report of few rows as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def merge_latest(spark: SparkSession, path: str, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The table at ``path`` and ``new`` with the first row of each key in ``order``; to be written to a new path and swapped,
    so that a failed run leaves the old table whole."""
    from ..operators.tables import latest

    return latest(spark.read.parquet(path).unionByName(new, allowMissingColumns=True), keys, *order)


def replace_partitions(df: DataFrame, path: str, partition_by: str) -> str:
    """Only the partitions that ``df`` has are replaced: an idempotent reload."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    return path


def run_log(spark: SparkSession, path: str, name: str, status: str, metadata: dict[str, str] | None = None) -> None:
    """Appends a run's status; the last row of a run counts."""
    pairs = [F.lit(v) for kv in (metadata or {}).items() for v in kv]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    spark.range(1).select(F.lit(name).alias("run"), F.lit(status).alias("status"), F.current_timestamp().alias("at"), meta.alias("metadata")).write.mode("append").parquet(path)


def promote(spark: SparkSession, staging: str, final: str, snapshot: str) -> None:
    """Puts the staged table in the place of the final one, which becomes the snapshot. The staged rows are first written whole
    beside the final table; then two renames follow, so that no reader sees half a table. There must be no snapshot of that name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, kept, fresh = hadoop.Path(final), hadoop.Path(snapshot), hadoop.Path(f"{final.rstrip('/')}.new-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(kept):
        raise ValueError(f"there is a snapshot already: {snapshot}")
    spark.read.parquet(staging).write.parquet(fresh.toString())
    files.mkdirs(kept.getParent())
    if files.exists(target) and not files.rename(target, kept):
        raise OSError(f"cannot move {final} to {snapshot}")
    if not files.rename(fresh, target):
        raise OSError(f"cannot move the new table to {final}")
