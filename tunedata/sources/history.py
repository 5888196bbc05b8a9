"""Run history: job snapshots appended to a table that outlives the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_history(snapshots: DataFrame, path: str, taken_at: Column) -> None:
    snapshots.withColumn("taken_at", taken_at).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """The latest snapshot of every job."""
    history = spark.read.parquet(path)
    values = [c for c in history.columns if c != key]
    latest = history.groupBy(key).agg(F.max_by(F.struct(*values), "taken_at").alias("_latest"))
    return latest.select(key, "_latest.*")
