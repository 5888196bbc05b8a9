"""Value shapes: a short code per cell that carries all a detection rule asks of a value.

A shape is a few bytes whatever the cell holds, so shapes (not cells) are what gets grouped,
shuffled and sampled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.dims import AUDIO_EXTENSIONS, IMAGE_EXTENSIONS
from tunedata.functions.text import has_extension

NULL, BOOL, INT, NUMBER, OBJECT, LIST, OTHER = "null", "bool", "int", "number", "object", "list", "other"
STRING, IMAGE_PATH, AUDIO_PATH = "string", "image_path", "audio_path"
FROM_VALUE, ROLE_CONTENT = "from_value_turns", "role_content_turns"

STRINGS = (STRING, IMAGE_PATH, AUDIO_PATH)


def _string_shape(c: Column) -> Column:
    return (
        F.when(has_extension(c, IMAGE_EXTENSIONS), IMAGE_PATH)
        .when(has_extension(c, AUDIO_EXTENSIONS), AUDIO_PATH)
        .otherwise(STRING)
    )


def _turns_shape(c: Column, element: T.DataType) -> Column:
    """Turn lists are told apart by their first turn only."""
    first = F.get(c, F.lit(0))
    if isinstance(element, T.MapType) and isinstance(element.keyType, T.StringType):
        def has(*keys: str) -> Column:
            found = F.lit(True)
            for key in keys:
                found = found & F.map_contains_key(first, key)
            return first.isNotNull() & found

        return F.when(has("from", "value"), FROM_VALUE).when(has("role", "content"), ROLE_CONTENT).otherwise(LIST)
    if not isinstance(element, T.StructType):
        return F.lit(LIST)
    names = set(element.names)
    sharegpt, chatml = {"from", "value"} <= names, {"role", "content"} <= names
    shape = F.when(first.isNull(), LIST)
    if sharegpt and chatml:  # a union of both kinds of row: the kind is the one filled in
        shape = shape.when(first["from"].isNotNull() | first["value"].isNotNull(), FROM_VALUE)
        return shape.otherwise(ROLE_CONTENT)
    if sharegpt or chatml:
        return shape.otherwise(FROM_VALUE if sharegpt else ROLE_CONTENT)
    return F.lit(LIST)


def shape_of(c: Column, dtype: T.DataType) -> Column:
    """Shape code of a typed column."""
    if isinstance(dtype, T.StringType):
        shape = _string_shape(c)
    elif isinstance(dtype, T.BooleanType):
        shape = F.lit(BOOL)
    elif isinstance(dtype, T.IntegralType):
        shape = F.lit(INT)
    elif isinstance(dtype, T.NumericType):
        shape = F.lit(NUMBER)
    elif isinstance(dtype, (T.StructType, T.MapType)):
        shape = F.lit(OBJECT)
    elif isinstance(dtype, T.ArrayType):
        shape = _turns_shape(c, dtype.elementType)
    else:
        shape = F.lit(OTHER)
    return F.when(c.isNull(), NULL).otherwise(shape)


def variant_shape(v: Column) -> Column:
    """Shape code of a VARIANT value; agrees with `shape_of` on the parsed value."""
    kind = F.schema_of_variant(v)
    first = F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant"))

    def turns(*keys: str) -> Column:
        test = first.startswith("OBJECT<")
        for key in keys:
            test = test & F.try_variant_get(v, f"$[0].{key}", "variant").isNotNull()
        return test

    return (
        F.when(v.isNull() | (kind == "VOID"), NULL)
        .when(kind == "STRING", _string_shape(F.try_variant_get(v, "$", "string")))
        .when(kind == "BOOLEAN", BOOL)
        .when(kind == "BIGINT", INT)
        .when(kind.startswith("OBJECT<"), OBJECT)
        .when(
            kind.startswith("ARRAY<"),
            F.when(turns("from", "value"), FROM_VALUE).when(turns("role", "content"), ROLE_CONTENT).otherwise(LIST),
        )
        .otherwise(NUMBER)
    )


def is_string(shape: Column) -> Column:
    return shape.isin(*STRINGS)


def is_media(shape: Column) -> Column:
    """An image path, or anything that is not a string (null included)."""
    return (shape == IMAGE_PATH) | ~is_string(shape)


def is_audio(shape: Column) -> Column:
    return shape.isin(AUDIO_PATH, OBJECT)


def is_flag(shape: Column) -> Column:
    return shape.isin(BOOL, INT)
