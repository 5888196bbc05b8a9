"""Catalog search and artifact manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunedata.functions.text import strip

# --- fixed values -----------------------------------------------------------------------
RELEASE_FILES = ("model.safetensors", "config.json", "tokenizer.json")
CHECKPOINT_PATTERN = "adapters/%.safetensors"
MIN_CHECKPOINTS = 21
MODEL_MARKER = "config.json"
SEARCH_LIMIT = 20
# --- end of fixed values ----------------------------------------------------------------


def _matches(catalog: DataFrame, query: str) -> DataFrame:
    if not query.strip():
        return catalog.where(F.lit(False))
    return catalog.where(F.contains(F.lower("id"), F.lit(query.lower())))


def _ranking(tie_break: Sequence[str]) -> list[Column]:
    return [F.col("downloads").desc(), *[F.col(c).asc() for c in tie_break]]


def search_datasets(
    catalog: DataFrame, query: str, limit: int = SEARCH_LIMIT, tie_break: Sequence[str] = ("id",)
) -> DataFrame:
    """Entries whose id contains the query, most downloaded first. A blank query finds nothing.

    Each task keeps `limit` rows, so the search is one pass and no sort of the catalog.
    """
    return _matches(catalog, query).orderBy(*_ranking(tie_break)).limit(limit)


def search_models(
    catalog: DataFrame,
    query: str,
    tag: str | None,
    limit: int = SEARCH_LIMIT,
    tie_break: Sequence[str] = ("id",),
) -> DataFrame:
    """As `search_datasets`, among entries with the tag; if none has it, among all.

    One pass: tagged entries rank first, so the top rows hold them all, up to the limit. What is
    left is to drop the untagged ones of those few rows if there is a tagged one.
    """
    if tag is None:
        return search_datasets(catalog, query, limit, tie_break)
    tagged = F.coalesce(F.array_contains("tags", tag), F.lit(False)).cast("int")
    top = _matches(catalog, query).withColumn("_tagged", tagged)
    top = top.orderBy(F.col("_tagged").desc(), *_ranking(tie_break)).limit(limit)
    best = F.max("_tagged").over(W.partitionBy(F.lit(0)))  # over `limit` rows
    kept = top.withColumn("_best", best).where(F.col("_tagged") == F.col("_best")).drop("_tagged", "_best")
    return kept.orderBy(*_ranking(tie_break))


def artifact_status(
    manifest: DataFrame,
    required: Sequence[str] = RELEASE_FILES,
    pattern: str = CHECKPOINT_PATTERN,
    minimum: int = MIN_CHECKPOINTS,
    key: str = "artifact",
    path: str = "path",
) -> DataFrame:
    """Per artifact: required files it lacks, matching checkpoint files, whether it is complete.

    One flag per required file and one counter are all the state, combined map-side.
    """
    flags = [F.max(F.col(path) == name).alias(f"_has_{i}") for i, name in enumerate(required)]
    # a file listed twice is one file
    folded = manifest.select(key, path).distinct() if minimum else manifest
    folded = folded.groupBy(key).agg(*flags, F.count_if(F.col(path).like(pattern)).alias("n_checkpoints"))
    lacking = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.col(f"_has_{i}"), F.lit(False)), name) for i, name in enumerate(required)])
    )
    complete = (F.size("missing") == 0) & (F.col("n_checkpoints") >= minimum)
    return folded.select(key, lacking.alias("missing"), "n_checkpoints").withColumn("complete", complete)


def valid_models(manifest: DataFrame, key: str = "artifact", path: str = "path") -> DataFrame:
    """Per directory: whether it holds a model configuration."""
    return manifest.groupBy(key).agg(F.coalesce(F.max(F.col(path) == MODEL_MARKER), F.lit(False)).alias("is_model"))
