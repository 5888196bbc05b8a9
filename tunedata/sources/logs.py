"""Log files as a table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_logs(spark: SparkSession, path: str) -> DataFrame:
    """Text logs, one file per job -> job_id (the file's name), seq, line.

    Large files are read in splits. A split of n bytes holds at most n lines, so its start offset
    plus the line's place in the split is a number that grows along the file. Finding where each
    split's rows begin takes one row per split; the lines themselves are not moved.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
        F.col("value").alias("line"),
    )
    first = read.groupBy("_file", "_start").agg(F.min("_place").alias("_first"))
    name = F.regexp_extract("_file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return read.join(first, ["_file", "_start"]).select(
        name.alias("job_id"), (F.col("_start") + F.col("_place") - F.col("_first")).alias("seq"), "line"
    )
