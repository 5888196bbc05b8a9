"""Whole-dataset operators: preview, ingest summary, split, length histogram, duplicates, pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.text import column, div
from tunedata.operators.blocks import running_total
from tunedata.operators.detect import Detection, detect

PREVIEW_ROWS = 8
PREVIEW_CHARS = 300


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first rows for display: numbers and flags as they are, all else as short text."""

    def shown(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            return column(f.name)
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        text = F.to_json(column(f.name)) if nested else column(f.name).cast("string")
        return F.left(F.coalesce(text, F.lit("None")), F.lit(PREVIEW_CHARS)).alias(f.name)

    first = df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
    return first.select(*[shown(f) for f in df.schema.fields])


def ingest(
    df: DataFrame,
    order_by: Sequence[str | Column] | None = None,
    overrides: Mapping[str, str] | None = None,
) -> tuple[int, DataFrame, Detection]:
    """Row count, preview and detection of a freshly loaded dataset."""
    return df.count(), preview(df, order_by=order_by), detect(df, order_by, overrides)


def bucket_of(key: Column, buckets: int = 100) -> Column:
    """A stable bucket 0..buckets-1 from the MD5 of a key: the same in every run and engine."""
    head = F.substring(F.md5(key.cast("string").cast("binary")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(buckets))


def train_validation_split(df: DataFrame, key: str, validation_percent: int = 10) -> DataFrame:
    """Add `split`, `validation` for that share of the keys and `train` for the rest."""
    held_out = bucket_of(F.col(key)) < validation_percent
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def length_histogram(df: DataFrame, text: str, width: int = 100) -> DataFrame:
    """(bucket_start, n_rows) of the number of whitespace-separated tokens per row."""
    tokens = F.regexp_count(F.col(text), F.lit(r"\S+"))
    start = div(tokens, width) * width
    return df.groupBy(start.alias("bucket_start")).agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_groups(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """Texts that occur more than once -> text_sha256, first_id, copies.

    Rows meet by a digest of the text, and copies are counted map-side, so a text that fills a
    third of the table costs one row per task in the shuffle.
    """
    counted = df.select(F.sha2(F.col(text), 256).alias("text_sha256"), F.col(row_id).alias("_id")).groupBy("text_sha256").agg(
        F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    return counted.where((F.col("copies") > 1) & F.col("text_sha256").isNotNull())


def expand_pairs(df: DataFrame, anchor: str, positives: str, negatives: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One (anchor, positive[, negative]) row per positive; negatives pair by position, if any."""
    if negatives is None:
        return df.select(*keep, column(anchor).alias("anchor"), F.explode(column(positives)).alias("positive"))
    exploded = df.select(
        *keep, column(anchor).alias("anchor"), column(negatives).alias("_negatives"), F.posexplode(column(positives)).alias("_i", "positive")
    )
    return exploded.select(*keep, "anchor", "positive", F.get("_negatives", F.col("_i")).alias("negative"))


def preference_pairs(rows: DataFrame, keys: Sequence[str], row_id: str, text: str, good: Column) -> DataFrame:
    """Preference pairs of labelled texts -> keys, pair, chosen_id, rejected_id, chosen, rejected.

    Within a key the good texts and the bad ones are numbered by `row_id`; the i-th goes with the i-th, and
    the smaller side starts over when it is used up, so every text of a key that has both sides is in a
    pair. Rows whose `good` is null take no part; keys may be null, ids are unique whole numbers.

    Numbers come from counts per block of ids (see `blocks`) and only ids travel for them; a text is
    fetched once its partner is known. A key with one text on its smaller side joins its whole larger
    side to that one row, which adaptive execution splits.
    """
    labelled = rows.select(*keys, F.col(row_id).cast("bigint").alias("_id"), good.cast("boolean").alias("_good")).where(F.col("_good").isNotNull())
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    ids = labelled.select(key.alias("_key"), F.when(F.col("_good"), 1).otherwise(0).alias("_side"), "_id")
    ranked = running_total(ids, ["_key", "_side"], ["_id"], F.lit(1), "_rank", exclusive=True)
    sides = ids.groupBy("_key").agg(F.count_if(F.col("_side") == 1).alias("_n_good"), F.count_if(F.col("_side") == 0).alias("_n_bad"))
    sides = sides.where((F.col("_n_good") > 0) & (F.col("_n_bad") > 0))
    sized = ranked.join(sides, "_key")
    larger_side = F.when(F.col("_n_good") >= F.col("_n_bad"), 1).otherwise(0)
    larger = sized.where(F.col("_side") == larger_side).select(
        "_key", "_side", "_id", F.col("_rank").alias("pair"), F.pmod("_rank", F.least("_n_good", "_n_bad")).alias("_slot")
    )
    smaller = sized.where(F.col("_side") != larger_side).select("_key", F.col("_rank").alias("_slot"), F.col("_id").alias("_other"))
    met = larger.join(smaller, ["_key", "_slot"])
    pairs = met.select(
        "pair",
        F.when(F.col("_side") == 1, F.col("_id")).otherwise(F.col("_other")).alias("chosen_id"),
        F.when(F.col("_side") == 1, F.col("_other")).otherwise(F.col("_id")).alias("rejected_id"),
    )
    chosen = rows.select(F.col(row_id).cast("bigint").alias("chosen_id"), *keys, F.col(text).alias("chosen"))
    rejected = rows.select(F.col(row_id).cast("bigint").alias("rejected_id"), F.col(text).alias("rejected"))
    return pairs.join(chosen, "chosen_id").join(rejected, "rejected_id").select(*keys, "pair", "chosen_id", "rejected_id", "chosen", "rejected")
