"""Large delimited files read by many tasks, although cells may hold line breaks.

Spark hands a file out by byte ranges, cut at line breaks. Whether such a break ends a record depends on
all quotes before it: after an even number of them it does. So lines are counted in blocks, the counts
summed up along the file (see `blocks`), and lines that belong together are joined. Nearly every record
is one line, or lies in one block, and is put together where it is; only records across the edge of a
block are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.text import column
from tunedata.operators.blocks import BLOCK, DEFAULT_SPAN, join_blocks, running_total


def csv_records(spark: SparkSession, path: str, span: int = DEFAULT_SPAN) -> DataFrame:
    """(file, at, is_first, record): the records of quoted text files, line breaks in quotes included.

    `at` grows along a file. Quotes inside quoted cells are doubled, so they do not change the count.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    quotes = F.regexp_count("line", F.lit('"'))
    numbered = running_total(lines, ["file"], ["at"], quotes, "_before", span=span, exclusive=True, keep_block=True)
    in_block = W.partitionBy("file", BLOCK).orderBy("at")
    starts = F.col("_before") % 2 == 0
    marked = numbered.select("file", "at", BLOCK, "line", starts.alias("_starts"))
    start = F.last(F.when(F.col("_starts"), F.col("at")), ignorenulls=True)
    marked = marked.withColumn("_start", start.over(in_block.rowsBetween(W.unboundedPreceding, W.currentRow)))
    marked = marked.withColumn("_next_starts", F.lead("_starts").over(in_block))

    # what a block inherits: the record that is open where it begins, and where its file begins
    edges = marked.groupBy("file", BLOCK).agg(F.max("_start").alias("_last"), F.min("at").alias("_least"))
    by_file = W.partitionBy("file").orderBy(BLOCK)
    open_ = F.last("_last", ignorenulls=True).over(by_file.rowsBetween(W.unboundedPreceding, -1))
    edges = edges.select("file", BLOCK, open_.alias("_open"), F.min("_least").over(W.partitionBy("file")).alias("_file_start"))
    joined = join_blocks(marked, edges, ["file"]).withColumn("_start", F.coalesce("_start", "_open"))

    single = F.coalesce(F.col("_starts") & F.col("_next_starts"), F.lit(False))
    whole = joined.where(single).select("file", "at", (F.col("at") == F.col("_file_start")).alias("is_first"), F.col("line").alias("record"))
    pieces = joined.where(~single).groupBy("file", F.col("_start").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("_lines"), F.min("_file_start").alias("_file_start")
    )
    across = pieces.select(
        "file", "at", (F.col("at") == F.col("_file_start")).alias("is_first"), F.array_join("_lines.line", "\n").alias("record")
    )
    return whole.unionByName(across)


def read_delimited_ranges(spark: SparkSession, path: str, separator: str, names: list[str], span: int = DEFAULT_SPAN) -> DataFrame:
    """The rows of CSV/TSV files with a header line each, by as many tasks as there are byte ranges.

    Cells are strings, absent ones null. Rows come in no particular order.
    """
    records = csv_records(spark, path, span).where(~F.col("is_first"))
    text = F.regexp_replace("record", "\\r$", "")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE"}
    rows = records.where(F.length(F.trim(text)) > 0).select(F.from_csv(text, schema.toDDL(), options).alias("_r"))
    return rows.select(*[column("_r")[f"c{i}"].alias(name) for i, name in enumerate(names)])
