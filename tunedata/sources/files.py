"""Dataset scans by file type, row caps, and the training-set sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.text import column
from tunedata.operators.blocks import running_total
from tunedata.sources.ranges import read_delimited_ranges
from tunedata.sources.session import case_sensitive

SUFFIXES = ("jsonl", "json", "csv", "tsv", "parquet")


def file_format(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in SUFFIXES:
        raise ValueError(f"Unsupported dataset format: {'.' + suffix if suffix else ''} (supported: {', '.join('.' + s for s in SUFFIXES)})")
    return suffix


def load_dataset(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    max_rows: int | None = None,
    mode: str = "FAILFAST",
    multi_line: bool = True,
    schema: T.StructType | str | None = None,
    ranges: bool = False,
) -> DataFrame:
    """Scan a dataset; the format follows from the suffix unless given (needed for folders).

    `mode` is what happens to malformed JSON (`PERMISSIVE` keeps them in `_corrupt_record`).
    CSV files whose cells may hold line breaks are read by one task each, or, with `ranges`, by a task
    for each byte range, at the price of a shuffle and of the order of rows; `multi_line=False` splits
    files without such cells. `schema` saves JSON its inference pass.
    """
    fmt = (format or file_format(path)).lower()
    with case_sensitive(spark):
        if fmt == "jsonl":
            df = _typed(spark.read.option("mode", mode), schema).json(path)
        elif fmt == "json":
            df = read_json_document(spark, path, mode, schema)
        elif fmt in ("csv", "tsv"):
            df = read_delimited(spark, path, "\t" if fmt == "tsv" else ",", multi_line, ranges)
        elif fmt == "parquet":
            df = spark.read.parquet(path)
        else:
            raise ValueError(f"Unsupported dataset format: {fmt!r}")
        return cap_rows(df, max_rows)


def _typed(reader, schema):
    return reader if schema is None else reader.schema(schema)


def read_json_document(
    spark: SparkSession, path: str, mode: str = "FAILFAST", schema: T.StructType | str | None = None
) -> DataFrame:
    """`.json`: a list of records, or an object whose first list (in document order) holds them.

    A JSON document is read by one task; many documents spread. Data of size belongs in JSONL.
    """
    documents = spark.read.text(path, wholetext=True)
    layouts = documents.select(F.to_json(F.json_object_keys("value")).alias("keys")).distinct().limit(2).collect()
    if len(layouts) > 1:
        raise ValueError("JSON files of different layouts: load them one by one.")
    reader = spark.read.option("multiLine", True).option("mode", mode)
    if not layouts or layouts[0]["keys"] is None:
        starts = documents.select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).distinct().limit(2).collect()
        if any(r["c"] != "[" for r in starts):
            raise ValueError("JSON file must contain a list of records.")
        return _typed(reader, schema).json(path)
    wrapper = reader.json(path)
    lists = {f.name for f in wrapper.schema.fields if isinstance(f.dataType, T.ArrayType)}
    keys = spark.range(1).select(F.from_json(F.lit(layouts[0]["keys"]), "array<string>")).first()[0]
    first = next((k for k in keys if k in lists), None)
    if first is None:
        raise ValueError("JSON file must contain a list of records.")
    element = next(f.dataType.elementType for f in wrapper.schema.fields if f.name == first)
    if not isinstance(element, (T.StructType, T.VariantType)):  # an empty list has no records to tell its type
        if wrapper.select(F.max(F.size(column(first)))).first()[0]:
            raise ValueError("JSON file must contain a list of records.")
        return spark.createDataFrame([], T.StructType([]))
    return wrapper.select(F.inline(column(first)))


def read_delimited(spark: SparkSession, path: str, separator: str, multi_line: bool = True, ranges: bool = False) -> DataFrame:
    """CSV/TSV with a header; every cell is a string, an absent or empty one is ''."""
    reader = spark.read.options(
        header=True, sep=separator, multiLine=multi_line, escape='"', inferSchema=False, mode="PERMISSIVE"
    )
    df = reader.csv(path)  # looks at the header only
    if ranges:
        df = read_delimited_ranges(spark, path, separator, df.columns)
    return df.select(*[F.coalesce(column(c), F.lit("")).alias(c) for c in df.columns])


def load_split(
    spark: SparkSession, root: str, name: str, split: str = "train", config: str | None = None, max_rows: int | None = None
) -> DataFrame:
    """A split of a named dataset stored as root/name/config=…/split=…; only its folder is listed, and a split
    that is not there is an error."""
    return cap_rows(spark.read.parquet(_split_path(root, name, split, config)), max_rows)


def _split_path(root: str, name: str, split: str, config: str | None) -> str:
    return f"{root.rstrip('/')}/{name}/config={config or 'default'}/split={split}"


def save_split(df: DataFrame, root: str, name: str, split: str = "train", config: str | None = None) -> None:
    """Write one split in the layout `load_split` reads."""
    df.write.mode("overwrite").parquet(_split_path(root, name, split, config))


def cap_rows(df: DataFrame, max_rows: int | None, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first `max_rows` rows; none or 0 means all.

    Without `order_by` rows count in the order of the scan's partitions: the rows of each partition are
    counted, the counts summed up, and a row stays if fewer than `max_rows` come before it. One small row
    per partition travels, the kept rows stay where they are read, and a larger cap keeps the rows of a
    smaller one. This holds for scans and row-wise work on them; after a shuffle, give `order_by`.
    """
    if not max_rows:
        return df
    if max_rows < 0:
        raise ValueError("max_rows must not be negative")
    if order_by:
        return df.orderBy(*order_by).limit(max_rows)
    place = F.monotonically_increasing_id()  # partition number, then the row's number in it
    placed = df.select(F.struct("*").alias("_row"), F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    before = running_total(counts, ["_all"], ["_part"], F.col("_n"), "_before", exclusive=True)
    kept = before.where(F.col("_before") < max_rows).select("_part", "_before")
    kept = F.broadcast(kept)  # 16 bytes for each task that reads
    return placed.join(kept, "_part").where(F.col("_before") + F.col("_at") < max_rows).select("_row.*")


def write_training_set(df: DataFrame, path: str, task: str, format: str = "parquet") -> str:
    """Write normalized rows to path/task=<task>, one folder per task since schemas differ."""
    if format not in ("parquet", "json"):
        raise ValueError(f"Unsupported sink format: {format!r}")
    target = f"{path.rstrip('/')}/task={task}"
    df.write.mode("overwrite").format(format).save(target)
    return target
