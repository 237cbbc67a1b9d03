"""A record, a step or a message opened once: every key that the library reads, from one parse of its text.

Keys whose type counts are VARIANT; those that hold further objects or lists stay text, which is opened in its turn. A string that
holds JSON is its text either way, so it needs no step of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of ids and step numbers, of what an agent said, and of objects in objects.
ID_KEYS = ("instance_id", "uid", "task_id", "sample_id", "id")
STEP_NAMES = ("global_step", "trainer_step", "validation_step", "training_step", "step", "iteration")
TEXT_FIELDS = ("response_text", "assistant_response", "completion", "response", "output", "text")
STEP_LISTS = ("p2a_step_traces", "steps", "traces")
TYPED = (*ID_KEYS, *STEP_NAMES, *TEXT_FIELDS, "data_source", "content")
TEXTS = (*STEP_LISTS, "tool_calls", "messages", "role", "extra_fields", "extra_info", "metadata", "tools_kwargs", "reward")
SCHEMA = ", ".join([f"`{k}` variant" for k in TYPED] + [f"`{k}` string" for k in TEXTS])
CALL = "function string, name string, arguments string, args string, tool_name string"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def opened(text: Column) -> Column:
    """The keys of a JSON object; all null for other texts."""
    return F.from_json(text, SCHEMA)


def kind(value: Column) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...> ...; null for JSON null and for what is missing."""
    return F.nullif(F.schema_of_variant(value), F.lit("VOID"))


def written(value: Column) -> Column:
    """A VARIANT as text: strings and numbers as they are, anything else as JSON."""
    return F.try_variant_get(value, "$", "string")


def text(value: Column) -> Column:
    """The trimmed string of a VARIANT; null for other types and for empty strings."""
    return F.when(kind(value) == "STRING", F.nullif(F.trim(written(value)), F.lit("")))


def boxes(raw: Column) -> Column:
    """The record and the objects in it that may carry its fields, opened: array of four, with null keys where one is missing."""
    return let(opened(raw), lambda o: F.array(o, opened(o["extra_fields"]), opened(o["extra_info"]), opened(o["metadata"])))


def deep(value: Column) -> Column:
    """A VARIANT in plain form: strings that hold a JSON object or list are decoded, at each level; anything else stays as it is.

    Levels below a list or an object are reached by their text, so one pass decodes one level of strings; eight passes are made.
    """
    holds = r'"((?:\{|\[)(?:[^"\\]|\\.)*(?:\}|\]))"'
    out = F.to_json(value)
    for _ in range(8):
        found = F.regexp_extract_all(out, F.lit(holds), F.lit(0))
        plain = F.filter(F.array_distinct(found), lambda s: F.try_parse_json(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0]).isNotNull())
        out = F.aggregate(plain, out, lambda t, s: F.replace(t, s, F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0]))
    return F.try_parse_json(out)
