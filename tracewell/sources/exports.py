"""Log-line exports: one folder of gzip files per UTC day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.actions import json_line
from tracewell.sources.folders import drop, partitions

# Fixed value: days of exports kept.
RETENTION_DAYS = 30


def export_lines(actions: DataFrame) -> DataFrame:
    return actions.select(json_line().alias("value"), F.col("ts").cast("date").alias("dt"))


def export_jsonl(actions: DataFrame, path: str) -> None:
    """Write every day of ``actions``; days written before are replaced."""
    (
        export_lines(actions)
        .hint("rebalance", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip")
        .partitionBy("dt")
        .text(path)
    )


def expired_exports(spark: SparkSession, path: str, today: date, keep: int = RETENTION_DAYS) -> DataFrame:
    """Day folders older than the retention, as rows (dt, folder)."""
    oldest = (today - timedelta(days=keep)).isoformat()
    rows = [(day, folder) for day, folder in partitions(spark, path).items() if day < oldest]
    return spark.createDataFrame(rows, "dt string, folder string")


def prune_exports(spark: SparkSession, path: str, today: date, keep: int = RETENTION_DAYS) -> int:
    expired = expired_exports(spark, path, today, keep).collect()  # one row per day
    for row in expired:
        drop(spark, row.folder)
    return len(expired)
