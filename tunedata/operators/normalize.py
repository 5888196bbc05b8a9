"""Rows of a detected format -> the schema a training task reads. Projections only, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata import dims
from tunedata.functions import chat
from tunedata.functions.text import column, truthy
from tunedata.operators.detect import Detection

CHAT_FORMATS = ("chatml", "sharegpt", "alpaca", "prompt_completion")
PREFERENCE_TASKS = ("dpo", "orpo", "simpo")

# What each task reads from the mapping, besides sft, which renders chats.
_REQUIRED = {
    "cpt": ("text",),
    "dpo": ("chosen", "rejected"),
    "orpo": ("chosen", "rejected"),
    "simpo": ("chosen", "rejected"),
    "kto": ("prompt", "completion", "label"),
    "grpo": ("prompt",),
    "embedding": ("anchor", "positive"),
    "tts_sft": ("audio", "text"),
    "stt_sft": ("audio", "text"),
    "ocr_sft": ("image", "text"),
    "vlm_sft": ("images", "messages"),
}


def check_compatible(detection: Detection, task: str) -> None:
    """Raise before any row is read if the task cannot use the detected format."""
    if task not in dims.TASK_BY_ID:
        raise ValueError(f"Unknown task {task!r}")
    if task == "sft":
        if detection.format != "text" and detection.format not in CHAT_FORMATS:
            raise ValueError(f"Cannot build messages from format {detection.format!r}")
        return
    missing = [f for f in _REQUIRED[task] if f not in detection.mapping]
    if not missing:
        return
    if task == "cpt":
        raise ValueError("CPT needs a raw text column.")
    raise ValueError(f"{task} needs {', '.join(missing)}; format {detection.format!r} does not provide it")


def is_compatible(detection: Detection, task: str) -> bool:
    try:
        check_compatible(detection, task)
    except ValueError:
        return False
    return True


def _type_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def _sharegpt_type(turns: T.DataType) -> T.DataType:
    value = turns.elementType.valueType if isinstance(turns.elementType, T.MapType) else turns.elementType["value"].dataType
    return T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", value)]))


def to_messages(df: DataFrame, detection: Detection) -> tuple[Column, T.DataType]:
    """The role/content messages of each row, and their type, for any chat-like format."""
    mapped, fmt = detection.mapping, detection.format
    if fmt == "chatml":
        return column(mapped["messages"]), _type_of(df, mapped["messages"])
    if fmt == "sharegpt":
        turns = mapped["conversations"]
        return chat.sharegpt_messages(column(turns)), _sharegpt_type(_type_of(df, turns))
    if fmt == "alpaca":
        given = mapped.get("input")
        extra = () if given is None else (column(given), _type_of(df, given))
        built = chat.alpaca_messages(
            column(mapped["instruction"]).cast("string"), column(mapped["output"]).cast("string"), *extra
        )
        return built, chat.TEXT_MESSAGES
    if fmt == "prompt_completion":
        built = chat.prompt_completion_messages(
            column(mapped["prompt"]).cast("string"), column(mapped["completion"]).cast("string")
        )
        return built, chat.TEXT_MESSAGES
    raise ValueError(f"Cannot build messages from format {fmt!r}")


def _vision_messages(df: DataFrame, name: str) -> Column:
    """role/content turns as they are; rows whose first turn has a `from` are remapped."""
    dtype, turns = _type_of(df, name), column(name)
    element = dtype.elementType if isinstance(dtype, T.ArrayType) else None
    if isinstance(element, T.MapType):
        # an absent key of a map is null; try_element_at keeps that under ANSI rules too
        at = lambda t, k: F.try_element_at(t, F.lit(k))
        pair = lambda one, two: F.transform(
            turns, lambda t: F.struct(at(t, one).alias(one), at(t, two).alias(two))
        )
        named = at(F.get(turns, F.lit(0)), "from").isNotNull()
        return F.when(named, chat.sharegpt_messages(pair("from", "value"))).otherwise(pair("role", "content"))
    if not isinstance(element, T.StructType) or "from" not in element.names:
        return turns
    if not {"role", "content"} <= set(element.names):
        return chat.sharegpt_messages(turns)
    kept = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return F.when(F.get(turns, F.lit(0))["from"].isNotNull(), chat.sharegpt_messages(turns)).otherwise(kept)


def normalize(
    df: DataFrame,
    detection: Detection,
    task: str,
    template: chat.Renderer | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project `df` to the task's schema. `keep` lets columns such as an id pass through."""
    check_compatible(detection, task)
    mapped = detection.mapping

    def same(*fields: str) -> list[Column]:
        return [column(mapped[f]).alias(f) for f in fields]

    if task == "sft" and detection.format != "text":
        messages, dtype = to_messages(df, detection)
        out = [chat.render_chat(messages, dtype, template).alias("text")]
    elif task in ("sft", "cpt"):
        out = same("text")
    elif task in PREFERENCE_TASKS:
        prompt = column(mapped["prompt"]) if "prompt" in mapped else F.lit("")
        out = [*same("chosen", "rejected"), prompt.alias("prompt")]
    elif task == "kto":
        label = truthy(column(mapped["label"]), _type_of(df, mapped["label"]))
        out = [*same("prompt", "completion"), label.alias("label")]
    elif task == "vlm_sft":
        out = [*same("images"), _vision_messages(df, mapped["messages"]).alias("messages")]
    else:
        out = same(*_REQUIRED[task])
    return df.select(*[column(k) for k in keep], *out)


def field_quality(df: DataFrame, task: str) -> DataFrame:
    """(field, n_rows, n_null, n_empty) of normalized rows against the task's declared schema."""
    spec = dims.TASK_BY_ID[task]
    types = {f.name: f.dataType for f in df.schema.fields}
    absent = [f for f in spec.dataset_schema if f not in types]
    if absent:
        raise ValueError(f"{task} rows lack {', '.join(absent)}")

    def empty(name: str) -> Column:
        dtype = types[name]
        if isinstance(dtype, T.StringType):
            return F.length(column(name)) == 0
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            return F.size(column(name)) == 0
        return F.lit(False)

    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(column(f).isNull()).alias(f"null_{f}") for f in spec.dataset_schema],
        *[F.count_if(empty(f)).alias(f"empty_{f}") for f in spec.dataset_schema],
    )
    cells = [
        F.struct(
            F.lit(f).alias("field"), F.col("n_rows"), F.col(f"null_{f}").alias("n_null"), F.col(f"empty_{f}").alias("n_empty")
        )
        for f in spec.dataset_schema
    ]
    return totals.select(F.inline(F.array(*cells)))
