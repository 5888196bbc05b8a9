"""String and truthiness helpers that keep the semantics of the dynamic rows they replace."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: every character Python's str.strip() removes. Spark's trim() alone drops spaces only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"[^\s\p{Z}\x1c-\x1f\x85]")  # stops at the first character that shows


def quoted(name: str) -> str:
    """Back-tick a column name so that dots, spaces and back-ticks inside it are literal."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def div(c: Column, n: int) -> Column:
    """Integer division, exact for every bigint (a floor of `/` goes through doubles)."""
    return F.call_function("div", c.cast("bigint"), F.lit(n).cast("bigint"))


def literal_map(entries: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def as_text(c: Column, dtype: T.DataType) -> Column:
    """What string interpolation prints for a value: null becomes the word None."""
    if isinstance(dtype, T.StringType):
        text = c
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("None"))


def truthy(c: Column, dtype: T.DataType) -> Column:
    """bool(value): null, 0, empty strings and empty collections are false."""
    if isinstance(dtype, T.BooleanType):
        test = c
    elif isinstance(dtype, T.NumericType):
        test = c != 0
    elif isinstance(dtype, (T.StringType, T.BinaryType)):
        test = F.length(c) > 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def has_extension(c: Column, extensions: tuple[str, ...]) -> Column:
    # an extension lies in the last few characters, so long texts are neither copied nor searched
    ending = F.right(c, F.lit(1 + max(map(len, extensions))))
    return F.lower(ending).rlike(r"\.(" + "|".join(extensions) + r")\z")
