"""Ordered running totals that no single key can stall.

A plain `OVER (PARTITION BY key ORDER BY seq)` puts a whole key in one task. Here the key's rows
are cut into blocks of `span` consecutive sequence numbers; every block is its own window
partition, and only one row per block (its total) is scanned per key to find what precedes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.text import div
from tunedata.sources.session import scratch_dir

BLOCK = "_block"
DEFAULT_SPAN = 1 << 16
BEFORE_ALL = -(1 << 63)  # block of rows without a number


def block_of(seq: str, span: int = DEFAULT_SPAN) -> Column:
    """Block number of a row. `seq` is an integer that grows along the key."""
    return div(F.col(seq), span)


def in_blocks(df: DataFrame, keys: Sequence[str], seq: str, span: int = DEFAULT_SPAN) -> DataFrame:
    """Add the block number. A null key stops the job: rows of no key have no order to scan in.

    The trailing constants are never reached. They make the columns not nullable, which spares the
    joins on them a null filter on one side and so lets both sides share a shuffle.
    """
    for name in keys:
        dtype = df.schema[name].dataType
        complaint = F.raise_error(F.lit(f"{name} must not be null")).cast(dtype)
        never = [F.lit("")] if isinstance(dtype, T.StringType) else []
        if isinstance(dtype, T.NumericType):
            never = [F.lit(0).cast(dtype)]
        df = df.withColumn(name, F.coalesce(F.col(name), complaint, *never))
    return df.withColumn(BLOCK, F.coalesce(block_of(seq, span), F.lit(0)))


def join_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring one-row-per-block values to the rows.

    `rows` come out of a window over (keys, block) and stay where they are; only `blocks` moves.
    """
    return rows.join(blocks, [*keys, BLOCK])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    span: int = DEFAULT_SPAN,
    exclusive: bool = False,
    total_name: str | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Add `name`: the sum of `value` over the key's rows up to this one, in `order`.

    `exclusive` leaves the row itself out. `total_name` adds the key's grand total as well.
    `keep_block` keeps the block number, for further windows over the same partitions.
    `order` must be unique within the key and its first column an integer.
    """
    blocked = in_blocks(df, keys, order[0], span)
    in_block = W.partitionBy(*keys, BLOCK).orderBy(*order)
    local = blocked.withColumn("_value", value.cast("bigint")).withColumn(
        "_local", F.sum("_value").over(in_block.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    totals = blocked.groupBy(*keys, BLOCK).agg(F.sum(value.cast("bigint")).alias("_block_total"))
    by_key = W.partitionBy(*keys).orderBy(BLOCK)
    carry = F.sum("_block_total").over(by_key.rowsBetween(W.unboundedPreceding, -1))
    added = [F.coalesce(carry, F.lit(0)).alias("_carry")]
    if total_name:
        added.append(F.sum("_block_total").over(W.partitionBy(*keys)).alias(total_name))
    blocks = totals.select(*keys, BLOCK, *added)
    result = F.col("_carry") + F.col("_local")
    if exclusive:
        result = result - F.col("_value")
    summed = join_blocks(local, blocks, keys).withColumn(name, result).drop("_value", "_local", "_carry")
    return summed if keep_block else summed.drop(BLOCK)


def in_last_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, span: int = DEFAULT_SPAN) -> DataFrame:
    """The rows of the blocks that hold the last `n` rows of every key, found before any row moves.

    Rows are counted per block, which reads keys and numbers only, and the counts summed up backwards: a
    block stays if fewer than `n` rows come after it. The list of blocks goes through the shared folder,
    so that Spark knows its size when it joins it to the scan.
    """
    spark = df.sparkSession
    blocked = df.withColumn(BLOCK, block_of(order[0], span))
    counts = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    later = W.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(W.unboundedPreceding, -1)
    needed = counts.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_after") < n)
    path = scratch_dir(spark, "last-blocks")
    needed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("_b")).write.parquet(path)
    needed = spark.read.parquet(path)
    same = F.col(BLOCK).eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return blocked.join(needed, same, "left_semi").drop(BLOCK)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, span: int = DEFAULT_SPAN) -> DataFrame:
    """The last `n` rows of every key, in no order.

    Rows are counted per block, which reads keys and numbers only, and the counts summed up backwards. A key of
    up to `n` rows keeps them all, unranked where they are read. A longer one is cut in one block: later blocks
    stay whole, earlier ones go, and only the rows of that block are ranked. The list of cuts, one row
    for each longer key, goes through the shared folder, so that Spark knows its size when it joins it.
    """
    spark = df.sparkSession
    blocked = df.withColumn(BLOCK, F.coalesce(block_of(order[0], span), F.lit(BEFORE_ALL)))
    counts = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    of_key = W.partitionBy(*keys)
    later = of_key.orderBy(F.col(BLOCK).desc()).rowsBetween(W.unboundedPreceding, -1)
    after = counts.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0))).withColumn("_all", F.sum("_n").over(of_key))
    cuts = after.where((F.col("_all") > n) & (F.col("_after") < n) & (F.col("_after") + F.col("_n") >= n))
    path = scratch_dir(spark, "cuts")
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    cuts.select(*names, F.col(BLOCK).alias("_cut"), (n - F.col("_after")).alias("_left")).write.parquet(path)
    cuts = spark.read.parquet(path)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    whole = blocked.join(cuts, same & (F.col(BLOCK) <= F.col("_cut")), "left_anti")
    edge = blocked.join(cuts, same & (F.col(BLOCK) == F.col("_cut")))
    place = F.row_number().over(of_key.orderBy(*[F.col(c).desc() for c in order]))
    edge = edge.withColumn("_place", place).where(F.col("_place") <= F.col("_left"))
    return whole.select(*df.columns).union(edge.select(*df.columns))


def beyond_limit(df: DataFrame, n: int) -> bool:
    """Whether Spark ranks all rows of a key to find its last `n`."""
    return n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, span: int = 1 << 20) -> DataFrame:
    """The last `n` rows of every key, with `_from_end` counting 1, 2, … backwards.

    Ranked per block first, so the final ranking of a key sees n rows per block at most. Spark drops what a
    task cannot need before the shuffle if `n` is within its limit for that; for a larger `n` only the
    last rows of every key are ranked.
    """
    newest_first = [F.col(c).desc() for c in order]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first))
    if beyond_limit(df, n):
        return newest_rows(df, keys, order, n).withColumn("_from_end", place)
    per_block = F.row_number().over(W.partitionBy(*keys, BLOCK).orderBy(*newest_first))
    candidates = df.withColumn(BLOCK, block_of(order[0], span)).withColumn("_in_block", per_block)
    candidates = candidates.where(F.col("_in_block") <= n).drop("_in_block", BLOCK)
    ranked = candidates.withColumn("_from_end", place)
    return ranked.where(F.col("_from_end") <= n)
