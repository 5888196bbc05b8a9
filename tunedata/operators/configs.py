"""Run configurations as tables: typing, defaults, trainer arguments, recipes, sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata import dims
from tunedata.functions.text import strip

# --- fixed values: the fields of a run and their defaults -------------------------------
_FIELDS: tuple[tuple[str, T.DataType, object], ...] = (
    ("task", T.StringType(), "sft"),
    ("model_name", T.StringType(), ""),
    ("max_seq_length", T.IntegerType(), 2048),
    ("load_in_4bit", T.BooleanType(), True),
    ("use_lora", T.BooleanType(), True),
    ("lora_r", T.IntegerType(), 16),
    ("lora_alpha", T.IntegerType(), 16),
    ("lora_dropout", T.DoubleType(), 0.0),
    ("target_modules", T.ArrayType(T.StringType()), dims.ATTENTION_TARGETS),
    ("output_dir", T.StringType(), "outputs"),
    ("batch_size", T.IntegerType(), 2),
    ("gradient_accumulation_steps", T.IntegerType(), 1),
    ("learning_rate", T.DoubleType(), 2e-4),
    ("max_steps", T.IntegerType(), 100),
    ("num_train_epochs", T.DoubleType(), None),
    ("warmup_steps", T.IntegerType(), 5),
    ("gradient_checkpointing", T.BooleanType(), False),
    ("seed", T.IntegerType(), 42),
    ("extra", T.MapType(T.StringType(), T.StringType()), {}),
)
BETA_TASKS = ("dpo", "orpo")
# --- end of fixed values ----------------------------------------------------------------

RUN_CONFIG = T.StructType([T.StructField(name, dtype) for name, dtype, _ in _FIELDS])
# As read from a document: scalars stay text until they are cast, so "1e-4" is a number either way.
GIVEN_CONFIG = T.StructType(
    [
        T.StructField(name, dtype if isinstance(dtype, (T.ArrayType, T.MapType)) else T.StringType())
        for name, dtype, _ in _FIELDS
    ]
)
RECIPE = T.StructType(
    [
        T.StructField("recipe_version", T.IntegerType()),
        T.StructField(
            "dataset", T.StructType([T.StructField("source", T.StringType()), T.StructField("local", T.BooleanType())])
        ),
        T.StructField("run", GIVEN_CONFIG),
    ]
)
STRICT = {"mode": "FAILFAST"}


def _default(value: object, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.array(*map(F.lit, value))
    if isinstance(dtype, T.MapType):
        return F.expr("cast(map() as map<string,string>)")
    return F.lit(value).cast(dtype)


def complete_config(given: Column) -> Column:
    """A full, typed run struct from one of `GIVEN_CONFIG`; a value of the wrong kind stops the job."""

    def value(name: str, dtype: T.DataType, default: Column) -> Column:
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            return F.coalesce(given[name], default)
        complaint = F.raise_error(F.concat(F.lit(f"Bad value for {name}: "), given[name])).cast(dtype)
        return F.coalesce(given[name].try_cast(dtype), F.when(given[name].isNull(), default).otherwise(complaint))

    return F.struct(*[value(name, dtype, _default(default, dtype)).alias(name) for name, dtype, default in _FIELDS])


def parse_configs(df: DataFrame, text: str = "config", name: str = "run") -> DataFrame:
    """Replace JSON text by a run struct: unknown keys are dropped, missing ones get their default.

    The parsed struct is a column of its own, so each document is parsed once, not once per field.
    """
    others = [c for c in df.columns if c not in (text, name)]
    parsed = df.select(*others, F.from_json(text, GIVEN_CONFIG, STRICT).alias("_given"))
    return parsed.select(*others, complete_config(F.col("_given")).alias(name))


def config_record(config: Column) -> Column:
    """The run as JSON, nulls included, so that parsing it gives the same run."""
    return F.to_json(config, {"ignoreNullFields": "false"})


def from_form(base: Column, form: Column) -> Column:
    """Apply form values to a run: typed casts, 0 epochs means none, beta only where it is used.

    `extra` is rebuilt from the form, so extras the run came with are gone.
    """
    beta = F.coalesce(form["beta"].cast("double"), F.lit(0.0))
    extra = F.when(
        base["task"].isin(*BETA_TASKS) & (beta != 0), F.create_map(F.lit("beta"), beta.cast("string"))
    ).otherwise(F.expr("cast(map() as map<string,string>)"))
    changed = {
        "output_dir": form["output_dir"],
        "batch_size": form["batch_size"].cast("int"),
        "gradient_accumulation_steps": form["grad_accum"].cast("int"),
        "learning_rate": form["lr"].cast("double"),
        "max_steps": form["max_steps"].cast("int"),
        "num_train_epochs": F.nullif(form["epochs"].cast("double"), F.lit(0.0)),
        "warmup_steps": form["warmup"].cast("int"),
        "gradient_checkpointing": form["grad_ckpt"].cast("boolean"),
        "seed": form["seed"].cast("int"),
        "extra": extra,
    }
    return F.struct(*[changed.get(name, base[name]).alias(name) for name in RUN_CONFIG.fieldNames()])


def only_accepted(args: Column, accepted: Column) -> Column:
    """Keep the arguments a target accepts; a null list means it accepts anything."""
    return F.when(accepted.isNull(), args).otherwise(F.map_filter(args, lambda k, _: F.array_contains(accepted, k)))


def merge_maps(*maps: Column) -> Column:
    """Union of maps, later ones winning, whatever the session's duplicate-key policy."""

    def unless_in(later: tuple[Column, ...]):
        def keep(k: Column, _: Column) -> Column:
            test = ~F.map_contains_key(later[0], k)
            for m in later[1:]:
                test = test & ~F.map_contains_key(m, k)
            return test

        return keep

    *earlier, last = maps
    kept = [F.map_filter(m, unless_in(maps[i + 1 :])) for i, m in enumerate(earlier)]
    return F.map_concat(*kept, last)


def with_task(runs: DataFrame, config: str = "run", strict: bool = True) -> DataFrame:
    """Join each run to its task's registry row.

    A run of an unknown task, or of none, stops the job; unless `strict`, it stays without task and
    `refused` says why (null for all others).
    """
    tasks = dims.tasks_df(runs.sparkSession)
    wanted = F.col(f"{config}.task")
    found = runs.join(F.broadcast(tasks), wanted == F.col("task"), "left")
    reason = F.concat(F.lit("Unknown task: "), F.coalesce(wanted, F.lit("null")))
    if strict:
        return found.withColumn("defaults", F.coalesce("defaults", F.raise_error(reason)))
    return found.withColumn("refused", F.when(F.col("defaults").isNull(), reason))


def trainer_args(run: Column, task_defaults: Column) -> Column:
    """The argument map of a run: its own values, then task defaults, then its extras.

    Epochs replace max_steps when set. Later entries win, so a task default also overrides the
    run's own value of the same name.
    """
    entries = {
        "output_dir": run["output_dir"],
        "per_device_train_batch_size": run["batch_size"],
        "gradient_accumulation_steps": run["gradient_accumulation_steps"],
        "learning_rate": run["learning_rate"],
        "warmup_steps": run["warmup_steps"],
        "seed": run["seed"],
    }
    by_epochs = F.coalesce(run["num_train_epochs"] != 0, F.lit(False))
    optional = {
        "num_train_epochs": F.when(by_epochs, run["num_train_epochs"].cast("string")),
        "max_steps": F.when(~by_epochs, run["max_steps"].cast("string")),
        "gradient_checkpointing": F.when(run["gradient_checkpointing"], "true"),
    }
    values = {**{k: v.cast("string") for k, v in entries.items()}, **optional}
    own = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_filter(merge_maps(own, task_defaults, run["extra"]), lambda _, v: v.isNotNull())


def build_trainer_args(runs: DataFrame, config: str = "run", strict: bool = True) -> DataFrame:
    """Add `args`, the trainer arguments of every run.

    A run of an unknown task stops the job; unless `strict`, it is listed with null arguments and the
    reason in `refused`.
    """
    joined = with_task(runs, config, strict)
    built = trainer_args(F.col(config), F.col("defaults"))
    if strict:
        return joined.select(*runs.columns, built.alias("args"))
    return joined.select(*runs.columns, F.when(F.col("refused").isNull(), built).alias("args"), "refused")


def task_listing(spark) -> DataFrame:
    """(label, id) choices and the info card of every task, in registry order."""
    return dims.tasks_df(spark).select(
        "position", "task", "task_label", "description", "trainer", "config", "dataset_schema", "notes"
    ).orderBy("position")


# --- recipes -------------------------------------------------------------------------------


def recipe_slug(name: Column, task: Column, saved_at: Column) -> Column:
    """File-safe name: the given one, else the task and a time stamp; spaces become dashes."""
    stamped = F.concat_ws("-", task, F.date_format(saved_at, "yyyyMMdd-HHmmss"))
    return F.replace(F.coalesce(F.nullif(strip(name), F.lit("")), stamped), F.lit(" "), F.lit("-"))


def recipe_document(run: Column, source: Column, local: Column) -> Column:
    """One recipe as a JSON document (which any YAML reader loads as well)."""
    document = F.struct(
        F.lit(1).alias("recipe_version"),
        F.struct(source.alias("source"), local.alias("local")).alias("dataset"),
        run.alias("run"),
    )
    return F.to_json(document, {"ignoreNullFields": "false"})


def resolve_recipe(recipe: Column) -> list[Column]:
    """run, source, is_local of a parsed recipe; a recipe without dataset has none."""
    return [
        complete_config(recipe["run"]).alias("run"),
        F.coalesce(recipe["dataset"]["source"], F.lit("")).alias("source"),
        F.coalesce(recipe["dataset"]["local"], F.lit(False)).alias("is_local"),
    ]


# --- sweeps --------------------------------------------------------------------------------


def sweep(runs: DataFrame, grid: Mapping[str, Sequence[object]], config: str = "run") -> DataFrame:
    """Every run with every combination of the grid's values; `variant` numbers them from 0.

    The grid is a literal exploded within each row, so nothing is shuffled.
    """
    types = {name: dtype for name, dtype, _ in _FIELDS}
    unknown = [name for name in grid if name not in types]
    if unknown:
        raise ValueError(f"Unknown run fields: {', '.join(unknown)}")
    out, variant = runs, F.lit(0)
    for name, values in grid.items():
        literals = F.array(*[F.lit(v).cast(types[name]) for v in values])
        out = out.select("*", F.posexplode(literals).alias(f"_i_{name}", f"_v_{name}"))
        variant = variant * len(values) + F.col(f"_i_{name}")
    changed = F.struct(
        *[(F.col(f"_v_{n}") if n in grid else F.col(config)[n]).alias(n) for n in RUN_CONFIG.fieldNames()]
    )
    kept = [c for c in runs.columns if c != config]
    return out.select(*kept, variant.cast("int").alias("variant"), changed.alias(config))


def compare_final_loss(sweep_runs: DataFrame, last_points: DataFrame, key: str = "job_id") -> DataFrame:
    """Sweep variants with their final loss, best first; variants without points come last."""
    joined = sweep_runs.join(last_points.select(key, "last_step", "last_loss"), key, "left")
    return joined.orderBy(F.col("last_loss").asc_nulls_last(), key)
