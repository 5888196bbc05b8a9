"""Tables the operators write between steps, and the shapes they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.sources.session import scratch_dir

WORD_BREAK = r"[\x20\x09-\x0D]+"
# bits of the table that says which ids are asked for: 16 for each, up to 16 MB
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the cluster's shared folder and read back: lineage ends here, and losing an
    executor later costs a read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by `saved` that no later result reads."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_in(column: Column, ids: DataFrame) -> Column:
    """Whether a long, never null, may be one of the column `id` of `ids` (it surely is not where this is false): a
    bit table sized by their number tells most others apart without a shuffle. Ids may repeat."""
    size = LEAST_BITS
    while size < min(MOST_BITS, 16 * ids.count()):
        size *= 2
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bit = F.expr("shiftleft(1L, cast(pmod(_spot, 64) as int))")
    bits = (
        ids.select(spot(F.col("id").cast("long")).alias("_spot"))
        .select(F.expr("cast(_spot div 64 as int)").alias("word"), bit.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    words = np.zeros(size // 64, np.int64)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(words)

    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for spots in batches:
            at = spots.to_numpy()
            yield pa.array(((shared.value[at // 64] >> (at % 64)) & 1).astype(bool))

    return F.arrow_udf(B.freed(held), "boolean")(spot(column.cast("long")))


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text column, null taken as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether a document is kept from training: crc32 of its id as text falls in fold 0.

    A null id is not in any fold and is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
