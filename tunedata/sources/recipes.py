"""Recipes: run configurations stored as YAML or JSON documents."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.operators.configs import RECIPE, recipe_document, recipe_slug, resolve_recipe


def _yaml_to_json(text: str | None) -> str | None:
    """JSON text of a YAML document; JSON is YAML already and passes through."""
    import yaml

    try:
        json.loads(text or "null")
        return text
    except ValueError:
        pass
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        return json.dumps(yaml.load(text, loader), ensure_ascii=False, default=str)
    except yaml.YAMLError:
        return None


def parse_recipes(documents: DataFrame, document: str = "value", keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Typed runs -> keep, run, source, is_local.

    YAML has no Spark reader, so its text becomes JSON in Arrow batches; the rest is typed
    columns. A document that has no `run` section stops the job, or is left out if not `strict`.
    """
    kept = [documents.schema[k] for k in keep]
    as_json = T.StructType([*kept, T.StructField("_json", T.StringType())])

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(keep)].assign(_json=batch[document].map(_yaml_to_json))

    parsed = documents.select(*keep, document).mapInPandas(convert, as_json)
    typed = parsed.select(
        *keep,
        F.from_json("_json", RECIPE).alias("_recipe"),
        F.coalesce(F.array_contains(F.json_object_keys("_json"), "run"), F.lit(False)).alias("_is_recipe"),
    )
    if strict:
        complaint = F.raise_error(F.lit("Not a recipe (missing `run` section)."))
        recipe = F.when(F.col("_is_recipe"), F.col("_recipe")).otherwise(complaint.cast(RECIPE))
        typed = typed.withColumn("_recipe", recipe)
    else:
        typed = typed.where("_is_recipe")
    return typed.select(*keep, *resolve_recipe(F.col("_recipe")))


def load_recipes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Every recipe file under `path` -> path, run, source, is_local."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_recipes(files, "value", ["path"], strict)


def list_recipes(spark: SparkSession, directory: str, suffix: str = ".yaml") -> DataFrame:
    """Recipe file paths, sorted; a missing directory has none. File contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")
    return files.select("path").orderBy("path")


def save_recipes(runs: DataFrame, path: str) -> DataFrame:
    """Write a table of recipes and return it: slug and document of every run.

    `runs` has name, saved_at, run, source, is_local.
    """
    table = runs.select(
        recipe_slug(F.col("name"), F.col("run.task"), F.col("saved_at")).alias("slug"),
        recipe_document(F.col("run"), F.col("source"), F.col("is_local")).alias("document"),
    )
    table.write.mode("overwrite").parquet(path)
    return runs.sparkSession.read.parquet(path)
