"""What one step of a trajectory did: its tool calls, texts, reads, action, signature and errors.

A step or a message is JSON text: an object, a list of calls and texts, or a plain string.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import objects
from .objects import CALL, TEXT_FIELDS, let
from .reads import READ, reads_in_command, reads_in_text, reads_in_tool_calls
from .text import normalize_path

CALLS = "array<struct<name:string,arguments:string>>"
#: Fields of which the first filled one is a response, roles that speak for the agent, arguments that tell calls apart.
FIRST_TEXT = ("response_text", "response", "assistant_response")
AGENT_ROLES = ("assistant", "agent", "model")
SIGNED = ("command", "path", "view_range", "old_str", "new_str")
EDITORS = ("str_replace_editor", "file_editor")
ERROR_WORDS = r"\b(traceback|exception|error|failed|failure|cannot|invalid)\b"
ERROR_REACH = 6000


def nested(raw: Column, *path: str) -> Column:
    """The value at a path, as text; a level that is itself a string of JSON is decoded on the way."""
    for key in path:
        raw = F.get_json_object(raw, f"$.{key}")
    return raw


def kind_of(raw: Column, key: str | None = None) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...> ...: the JSON type of ``raw`` or of one of its keys; null where there is none."""
    value = F.try_parse_json(raw)
    return F.schema_of_variant(value if key is None else F.try_variant_get(value, f"$.{key}", "variant"))


def items_of(text: Column) -> Column:
    """The items of a JSON list as texts; anything else has none."""
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def tool_calls(value: Column) -> Column:
    """Calls (name, arguments as JSON) of a list of calls, of one call, or of an object that holds ``tool_calls``.

    Three spellings count: ``function``, ``name`` with arguments, and ``tool_name``; other items are left out.
    """
    inner = F.when(is_object(value), F.coalesce(nested(value, "tool_calls"), value)).otherwise(value)
    return let(inner, _calls)


def _calls(inner: Column) -> Column:
    found = F.when(is_object(inner), F.array(inner)).otherwise(items_of(inner))

    def one(c: Column) -> Column:
        own, function = F.coalesce(c["arguments"], c["args"]), F.from_json(c["function"], "name string, arguments string")
        name = F.when(is_object(c["function"]), function["name"]).when(own.isNotNull() & c["name"].isNotNull(), c["name"]).otherwise(c["tool_name"])
        return F.struct(name.alias("name"), F.when(is_object(c["function"]), function["arguments"]).otherwise(own).alias("arguments"))

    calls = F.transform(F.transform(F.filter(found, is_object), lambda c: F.from_json(c, CALL)), one)
    return F.filter(calls, lambda c: c["name"].isNotNull()).cast(CALLS)


def content_of(value: Column) -> Column:
    """The text of a VARIANT: a string as it is, or the texts of a list of parts, one to a line; else empty."""
    part = lambda p: F.when(is_object(p), F.coalesce(nested(p, "text"), nested(p, "content"))).otherwise(p)
    parts = lambda v: F.filter(F.transform(items_of(objects.written(v)), part), lambda p: p.isNotNull())
    return F.when(objects.kind(value) == "STRING", objects.written(value)).when(objects.kind(value).startswith("ARRAY"), F.array_join(parts(value), "\n")).otherwise("")


def _agent_messages(messages: Column) -> Column:
    speaks = lambda m: F.coalesce(F.lower(m["role"]).isin(*AGENT_ROLES), F.lit(False)) | m["tool_calls"].isNotNull()
    return F.filter(F.transform(F.filter(items_of(messages), is_object), lambda m: F.from_json(m, "role string, content variant, tool_calls string")), speaks)


def said(raw: Column) -> Column:
    """struct(texts, calls, n_own, first): what an object says in its text fields and agent messages, and calls there.

    The first ``n_own`` calls are its own; ``first`` is its first filled response. Lists of calls and texts, and plain texts, are
    read as such. Null says nothing.
    """
    return let(objects.opened(raw), lambda o: said_by(raw, o))


def said_by(raw: Column, o: Column) -> Column:
    """``said`` of a text that is opened already."""
    none, no_calls = F.array().cast("array<string>"), F.array().cast(CALLS)

    def of(messages: Column) -> Column:
        texts = F.concat(F.array(*[content_of(o[f]) for f in TEXT_FIELDS]), F.transform(messages, lambda m: content_of(m["content"])))
        plain = F.when(F.ltrim(raw).startswith("["), F.filter(items_of(raw), lambda i: ~is_object(i))).otherwise(F.array(raw))
        own = F.when(is_object(raw), F.coalesce(tool_calls(o["tool_calls"]), no_calls)).otherwise(tool_calls(raw))
        theirs = F.when(is_object(raw), F.flatten(F.transform(messages, lambda m: F.coalesce(tool_calls(m["tool_calls"]), no_calls)))).otherwise(no_calls)
        spoken = F.array_distinct(F.filter(F.coalesce(F.when(is_object(raw), texts).otherwise(plain), none), lambda t: t.isNotNull() & (t != "")))
        first = F.coalesce(*[F.nullif(objects.written(o[f]), F.lit("")) for f in FIRST_TEXT])
        return let(F.coalesce(own, no_calls), lambda w: F.struct(spoken.alias("texts"), F.concat(w, F.coalesce(theirs, no_calls)).alias("calls"), F.size(w).alias("n_own"), first.alias("first")))

    return let(_agent_messages(o["messages"]), of)


def may_speak(o: Column) -> Column:
    """Whether an opened object has a key with which it could say or call something; without one there is nothing to be looked through."""
    return reduce(or_, [o[k].isNotNull() for k in (*TEXT_FIELDS, "messages", "tool_calls")])


def distinct_reads(reads: Column) -> Column:
    return F.array_distinct(F.filter(reads, lambda r: r["file_path"].isNotNull() & (r["file_path"] != "")))


def reads_of(raw: Column, spoken: Column, mode: str = "view_and_bash") -> Column:
    """struct(reads, core) of a text and what it ``said``: its reads, each once; and those of its own calls and its first filled text, repeats included.

    The patterns, the costly part, run once over each distinct text.
    """

    def of(s: Column) -> Column:
        texts = F.transform(s["texts"], lambda t: F.struct(t.alias("text"), reads_in_text(t, mode).alias("reads")))
        calls = F.transform(s["calls"], lambda c: reads_in_tool_calls(F.array(c)))
        return let(texts, lambda by_text: let(calls, lambda by_call: both(s, by_text, by_call)))

    def both(s: Column, by_text: Column, by_call: Column) -> Column:
        own = F.flatten(F.slice(by_call, F.lit(1), s["n_own"]))
        of_first = F.flatten(F.transform(F.filter(by_text, lambda x: x["text"] == s["first"]), lambda x: x["reads"]))
        reads = distinct_reads(F.concat(F.flatten(by_call), F.flatten(F.transform(by_text, lambda x: x["reads"]))))
        return F.struct(reads.alias("reads"), F.when(is_object(raw), F.concat(own, of_first)).otherwise(F.array().cast(READ)).alias("core"))

    return let(spoken, of)


def with_reads(df: DataFrame, raw: str, mode: str = "view_and_bash") -> DataFrame:
    """``df`` with ``reads`` and ``core`` of the JSON column ``raw``, as ``reads_of`` gives them."""
    return df.withColumn("_reads", reads_of(F.col(raw), said(F.col(raw)), mode)).withColumns({"reads": F.col("_reads.reads"), "core": F.col("_reads.core")}).drop("_reads")


def action(step: Column, mode: str = "view_and_bash") -> Column:
    """struct(family, target, tool, arguments) of a step's first tool call: read, edit, exec or other."""
    return let(nested(step, "tool_calls"), lambda calls: action_of(calls, mode))


def action_of(calls: Column, mode: str = "view_and_bash") -> Column:
    """``action`` of a step's list of calls, as text."""
    function = F.from_json(nested(F.get(items_of(calls), F.lit(0)), "function"), "name string, arguments string")
    return let(function, lambda f: let(F.from_json(f["arguments"], "command string, path variant"), lambda a: _action(F.coalesce(f["name"], F.lit("")), f["arguments"], a, mode)))


def _action(name: Column, args: Column, a: Column, mode: str) -> Column:
    command = F.coalesce(a["command"], F.lit(""))
    target = F.when(objects.kind(a["path"]) == "STRING", normalize_path(F.nullif(objects.written(a["path"]), F.lit(""))))
    paths = F.when(name == "execute_bash", F.array_distinct(F.transform(reads_in_command(command).cast(READ), lambda r: r["file_path"]))).otherwise(F.array().cast("array<string>"))

    def of(found: Column) -> Column:
        viewer = name.isin(*EDITORS)
        family = (
            F.when(viewer & (command == "view"), "read").when(viewer & (command != ""), "edit")
            .when((name == "execute_bash") & (F.size(found) > 0), "read").when(name == "execute_bash", "exec").otherwise("other")
        )
        where = F.when(name == "execute_bash", F.when(F.size(found) == 1, F.get(found, F.lit(0)))).otherwise(target)
        return F.struct(family.alias("family"), where.alias("target"), name.alias("tool"), args.alias("arguments"))

    return let(paths if mode == "view_and_bash" else F.array().cast("array<string>"), of)


def signature(act: Column) -> Column:
    """Equal for two steps that do the same: family, target, tool and the start of each argument that counts."""
    args = F.struct(*[F.substring(nested(act["arguments"], k), 1, 120).alias(k) for k in SIGNED])
    return F.to_json(F.struct(act["family"].alias("family"), act["target"].alias("target"), act["tool"].alias("tool"), args.alias("args")))


def error_in(step: str | None) -> bool:
    """Whether the start of a step, written as JSON with spaces and escapes, names an error; empty steps do not."""
    value = step
    if step is not None and step.strip()[:1] in ("[", "{"):
        try:
            value = json.loads(step)
        except ValueError:
            value = step
    return bool(value) and re.search(ERROR_WORDS, json.dumps(value)[:ERROR_REACH], re.IGNORECASE) is not None


@F.pandas_udf(T.BooleanType())
def _has_error(step: pd.Series) -> pd.Series:
    # The JVM's to_json escapes and spaces differently, which moves both word ends and the cut.
    return step.map(error_in)


def has_error(step: Column | str) -> Column:
    """``error_in`` of a step. Only texts with one of the words, or with an escape that could hide one, go through Python; the others are sent as null."""
    c = F.col(step) if isinstance(step, str) else step
    words = "(?i)" + ERROR_WORDS.replace(r"\b", "")
    return _has_error(F.when(c.rlike(words) | c.contains("\\u"), c))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _have_errors(steps: pd.Series) -> pd.Series:
    return steps.map(lambda row: [error_in(s) for s in row])


def have_errors(steps: Column | str) -> Column:
    """``error_in`` of each step of a list; lists without a suspect text don't leave the JVM."""
    words = "(?i)" + ERROR_WORDS.replace(r"\b", "")
    suspects = F.transform(steps, lambda c: F.when(c.rlike(words) | c.contains("\\u"), c))
    return F.coalesce(_have_errors(F.when(F.exists(suspects, lambda c: c.isNotNull()), suspects).otherwise(F.array().cast("array<string>"))), F.array().cast("array<boolean>"))


def native_calls(text: Column, block: str, invoke: str, parameter: str) -> Column:
    """Calls (name, arguments as JSON) written in a provider's own markup; patterns give body, (name, body) and (name, value)."""

    def call(m: Column) -> Column:
        params = F.regexp_extract_all(F.regexp_extract(m, invoke, 2), F.lit(parameter), F.lit(0))
        pairs = F.transform(params, lambda p: F.struct(F.trim(F.regexp_extract(p, parameter, 1)).alias("key"), F.trim(F.regexp_extract(p, parameter, 2)).alias("value")))
        last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda y: y["key"] == x["key"]))
        return F.struct(F.trim(F.regexp_extract(m, invoke, 1)).alias("name"), F.to_json(F.map_from_entries(last)).alias("arguments"))

    bodies = F.array_join(F.regexp_extract_all(text, F.lit(block), F.lit(1)), "\n")
    return F.filter(F.transform(F.regexp_extract_all(bodies, F.lit(invoke), F.lit(0)), call), lambda c: c["name"] != "").cast(CALLS)
