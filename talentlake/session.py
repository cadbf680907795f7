"""A local session with the settings the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """For tests and laptops; on a cluster the caller brings a session. ANSI and UTC are what the queries assume."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("talentlake").config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
