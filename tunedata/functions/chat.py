"""Chat rows: building role/content messages and rendering them to text.

All of it is per-row Column work on arrays: no shuffle, no Python workers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.dims import SHAREGPT_ROLES
from tunedata.functions.text import as_text, literal_map, strip, truthy

TEXT_MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

# --- fixed values: the Llama-3 chat layout ----------------------------------------------
BEGIN = "<|begin_of_text|>"
HEADER_OPEN = "<|start_header_id|>"
HEADER_CLOSE = "<|end_header_id|>\n\n"
END_OF_TURN = "<|eot_id|>"
KNOWLEDGE_LINE = "Cutting Knowledge Date: December 2023\n"
TODAY_PREFIX = "Today Date: "
TOOLS_ENVIRONMENT = "Environment: ipython\n"
TOOLS_IN_SYSTEM = (
    "You have access to the following functions. To call a function, please respond with JSON for a function call."
)
TOOLS_IN_USER = (
    "Given the following functions, please respond with a JSON for a function call "
    "with its proper arguments that best answers the given prompt.\n\n"
)
TOOLS_FORMAT = (
    'Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}.'
    "Do not use variables.\n\n"
)
# --- end of fixed values ----------------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sharegpt_messages(turns: Column) -> Column:
    """from/value turns as role/content messages; unlisted speakers become the user."""
    roles = literal_map(SHAREGPT_ROLES)
    return F.transform(
        turns,
        lambda t: F.struct(
            F.coalesce(F.try_element_at(roles, F.coalesce(t["from"].cast("string"), F.lit(""))), F.lit("user")).alias(
                "role"
            ),
            t["value"].alias("content"),
        ),
    )


def alpaca_messages(
    instruction: Column, output: Column, given: Column | None = None, given_type: T.DataType = T.StringType()
) -> Column:
    """One user and one assistant message; a non-empty input follows the instruction."""
    user = instruction
    if given is not None:
        joined = F.concat(F.coalesce(instruction, F.lit("None")), F.lit("\n\n"), as_text(given, given_type))
        user = F.when(truthy(given, given_type), joined).otherwise(instruction)
    return F.array(message("user", user), message("assistant", output))


def prompt_completion_messages(prompt: Column, completion: Column) -> Column:
    return F.array(message("user", prompt), message("assistant", completion))


def _field_type(messages_type: T.DataType, name: str) -> T.DataType:
    element = messages_type.elementType
    if isinstance(element, T.MapType):
        return element.valueType
    return element[name].dataType


def render_generic(messages: Column, messages_type: T.DataType = TEXT_MESSAGES) -> Column:
    """`<|role|>` and content per message, one line break after each; no message gives "\\n".

    The text of a list is the text of its head followed by that of its tail.
    """
    role_type, content_type = _field_type(messages_type, "role"), _field_type(messages_type, "content")
    pieces = F.transform(
        messages,
        lambda m: F.concat(
            F.lit("<|"), as_text(m["role"], role_type), F.lit("|>\n"), as_text(m["content"], content_type)
        ),
    )
    return F.concat(F.array_join(pieces, "\n"), F.lit("\n"))


def json_text(c: Column, dtype: T.DataType) -> Column:
    """JSON in the spacing of Python's json.dumps (", " and ": ")."""
    if isinstance(dtype, T.StructType):
        members = [
            F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), json_text(c[f.name], f.dataType))
            for f in dtype.fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                json_text(e["key"].cast("string"), T.StringType()), F.lit(": "), json_text(e["value"], dtype.valueType)
            ),
        )
        text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: json_text(x, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        one = F.to_json(F.array(c.cast("string")))
        text = F.substring(one, F.lit(2), F.length(one) - 2)
    return F.when(c.isNull(), "null").otherwise(text)


def _header(role: Column) -> Column:
    return F.concat(F.lit(HEADER_OPEN), role, F.lit(HEADER_CLOSE))


@dataclass(frozen=True)
class Place:
    """Where a piece lies in its chat: `offset` turns come before it, of `total`; whether the chat opens
    with a system turn, and whether all its turns have a role (`sound`)."""

    offset: Column
    total: Column
    system_first: Column
    sound: Column

    @classmethod
    def of(cls, name: str) -> Place:
        """From a column with these four fields."""
        return cls(*[F.col(name)[f] for f in ("offset", "total", "system_first", "sound")])

    @property
    def starts(self) -> Column:
        return self.offset == 0

    def ends(self, messages: Column) -> Column:
        return self.offset + F.size(messages) >= self.total

    def with_question(self) -> Place:
        """The place of the piece in a chat that one more turn ends."""
        return replace(self, total=self.total + 1)


def render_llama3(
    messages: Column,
    messages_type: T.DataType = TEXT_MESSAGES,
    *,
    date_string: str | Column,
    add_generation_prompt: bool | Column = False,
    tools: Sequence[dict] | None = None,
    tools_in_user_message: bool = True,
    place: Place | None = None,
) -> Column:
    """Llama-3 chat layout; null where the layout rejects the row (see `render_chat`).

    `date_string` is a parameter, never the clock, so a rerun gives the same rows. `tools` is a
    job constant and is serialised once, on the driver. `place` says which piece of a longer chat
    the list is: the texts of the pieces of a chat join to the text of the whole.
    """
    element = messages_type.elementType
    fields = set(element.names) if isinstance(element, T.StructType) else {"role", "content"}
    content_type = _field_type(messages_type, "content")
    date = F.lit(date_string) if isinstance(date_string, str) else date_string
    tool_text = "".join(json.dumps(t, indent=4, ensure_ascii=False) + "\n\n" for t in tools or ())
    has_tools = tools is not None

    def content(m: Column) -> Column:
        return strip(as_text(m["content"], content_type))

    first = F.get(messages, F.lit(0))
    opens_with_system = F.coalesce(first["role"] == "system", F.lit(False))
    if place is not None:
        opens_with_system = opens_with_system & place.starts
    rest = F.when(opens_with_system, F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)
    valid = F.size(messages) > 0

    opening = F.concat(
        F.lit(BEGIN),
        _header(F.lit("system")),
        F.lit((TOOLS_ENVIRONMENT if has_tools else "") + KNOWLEDGE_LINE + TODAY_PREFIX),
        date,
        F.lit("\n\n"),
        F.lit(TOOLS_IN_SYSTEM + TOOLS_FORMAT + tool_text if has_tools and not tools_in_user_message else ""),
        F.when(opens_with_system, content(first)).otherwise(""),
        F.lit(END_OF_TURN),
    )
    if has_tools and tools_in_user_message:
        # the tools go into the first message that is not the system's, wherever that lies
        here, some = F.size(rest) > 0, F.size(rest) > 0
        if place is not None:
            here = (place.starts & here) | (place.system_first & (place.offset == 1))
            some = place.total > place.system_first.cast("int")
        valid = valid & some
        given = F.concat(
            _header(F.lit("user")),
            F.lit(TOOLS_IN_USER + TOOLS_FORMAT + tool_text),
            content(F.get(rest, F.lit(0))),
            F.lit(END_OF_TURN),
        )
        rest = F.when(here, F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))).otherwise(rest)
    else:
        given, here = F.lit(""), F.lit(False)

    def is_result(m: Column) -> Column:
        return F.coalesce(m["role"].isin("ipython", "tool"), F.lit(False))

    def result_text(m: Column) -> Column:
        if isinstance(content_type, (T.NumericType, T.BooleanType)):
            return as_text(m["content"], content_type)
        return F.when(m["content"].isNull(), "None").otherwise(json_text(m["content"], content_type))

    def turn(m: Column) -> Column:
        plain = F.concat(_header(m["role"]), content(m), F.lit(END_OF_TURN))
        result = F.concat(_header(F.lit("ipython")), result_text(m), F.lit(END_OF_TURN))
        text = F.when(is_result(m), result).otherwise(plain)
        if "tool_calls" not in fields:
            return text
        function = F.get(m["tool_calls"], F.lit(0))["function"]
        arguments_type = element["tool_calls"].dataType.elementType["function"].dataType["arguments"].dataType
        call = F.concat(
            _header(F.lit("assistant")),
            F.lit('{"name": "'), function["name"], F.lit('", "parameters": '),
            json_text(function["arguments"], arguments_type),
            F.lit("}" + END_OF_TURN),
        )
        # null unless there is exactly one call: the row then falls back
        return F.when(m["tool_calls"].isNull(), text).when(F.size(m["tool_calls"]) == 1, call)

    turns = F.transform(rest, turn)
    valid = valid & ~F.exists(turns, lambda t: t.isNull())
    opening_here = F.lit(True)
    if place is not None:
        opening_here, valid = place.starts, valid & place.sound
    opening = F.concat(F.when(opening_here, opening).otherwise(""), F.when(here, given).otherwise(""))
    asked = F.lit(add_generation_prompt) if isinstance(add_generation_prompt, bool) else add_generation_prompt
    if place is not None:
        asked = asked & place.ends(messages)
    closing = F.when(asked, _header(F.lit("assistant"))).otherwise("")
    return F.when(valid, F.concat(opening, F.array_join(turns, ""), closing))


Renderer = Callable[[Column, T.DataType], Column]


def llama3(**options) -> Renderer:
    """A renderer for `normalize(..., template=llama3(date_string=...))`."""
    return lambda messages, messages_type: render_llama3(messages, messages_type, **options)


def render_chat(
    messages: Column, messages_type: T.DataType = TEXT_MESSAGES, template: Renderer | None = None
) -> Column:
    """The template's text; rows it rejects, or no template at all, use the generic layout."""
    generic = render_generic(messages, messages_type)
    return generic if template is None else F.coalesce(template(messages, messages_type), generic)


def build_prompt(
    history: Column, user_message: Column, template: Renderer | None = None, place: Place | None = None
) -> Column:
    """Text to complete: the history and a new user message, then the assistant's header.

    `template` must add the generation prompt; rows it rejects get the bare contents, one per line.
    With `place` (of the history, and as `with_question` also in `template`) the history is one piece of
    a longer chat: the question follows the last piece, and the texts of the pieces join to the whole.
    """
    asked = F.array(message("user", user_message))
    if place is not None:
        asked = F.when(place.ends(history), asked).otherwise(F.slice(asked, 1, 0))
    messages = F.concat(history, asked)
    bare = F.array_join(F.transform(messages, lambda m: m["content"]), "\n")
    if place is not None:
        bare = F.concat(bare, F.when(place.ends(history), "").otherwise("\n"))
    return bare if template is None else F.coalesce(template(messages, TEXT_MESSAGES), bare)
