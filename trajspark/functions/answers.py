"""What a model's answer says: text, reasoning and tool calls, also calls that a model has written into its text in its own markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .objects import let
from .steps import CALLS, is_object, items_of, nested

#: Two markups of calls. A block, a call in it (name, body) and a parameter (name, type, value); whether untyped values are strings.
_MARK, _END = r"<｜｜DSML｜｜", r"</｜｜DSML｜｜"
MARKUPS = (
    (rf"{_MARK}tool_calls>([\s\S]*?)(?:{_END}tool_calls>|\z)", rf'{_MARK}invoke name="([^"]+)">([\s\S]*?)(?:{_END}invoke>|\z)', rf'{_MARK}parameter name="([^"]+)"(?:\s+string="(true|false)")?>([\s\S]*?){_END}parameter>', True),
    (r"<minimax:tool_call>([\s\S]*?)(?:</minimax:tool_call>|\z)", r'<invoke name="([^"]+)">([\s\S]*?)(?:</invoke>|\z)', r'<parameter name="([^"]+)"()>([\s\S]*?)</parameter>', False),
)


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return let(F.to_json(F.struct(text.alias("v"))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6))


def _calls(text: Column, block: str, invoke: str, parameter: str, strings: bool) -> Column:
    def pair(m: Column) -> Column:
        raw, kind = F.trim(F.regexp_extract(m, parameter, 3)), F.regexp_extract(m, parameter, 2)
        plain = (kind == "true") | ((kind == "") & F.lit(strings))
        value = F.when(~plain & F.try_parse_json(raw).isNotNull() & (raw != ""), raw).otherwise(_quoted(raw))
        return F.struct(F.trim(F.regexp_extract(m, parameter, 1)).alias("key"), value.alias("value"))

    def call(m: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(F.regexp_extract(m, invoke, 2), F.lit(parameter), F.lit(0)), pair)
        last = lambda ps: F.filter(ps, lambda x, i: ~F.exists(F.slice(ps, i + F.lit(2), F.size(ps)), lambda y: y["key"] == x["key"]))
        arguments = let(pairs, lambda ps: F.concat(F.lit("{"), F.array_join(F.transform(last(ps), lambda p: F.concat(_quoted(p["key"]), F.lit(": "), p["value"])), ", "), F.lit("}")))
        return F.struct(F.trim(F.regexp_extract(m, invoke, 1)).alias("name"), arguments.alias("arguments"))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(block), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(invoke), F.lit(0))))
    return F.filter(F.transform(found, call), lambda c: c["name"] != "").cast(CALLS)


def recovered(text: Column) -> Column:
    """struct(text, calls): calls written in a text in one of the markups, the first that gives any, and the text without its blocks; without calls the text as it is."""
    found = [F.struct(F.trim(F.regexp_replace(text, m[0], "")).alias("text"), _calls(text, *m).alias("calls")) for m in MARKUPS]
    none = F.struct(text.alias("text"), F.array().cast(CALLS).alias("calls"))
    return let(F.filter(F.array(*found), lambda x: F.size(x["calls"]) > 0), lambda x: F.coalesce(F.get(x, F.lit(0)), none))


def _listed_calls(calls: Column) -> Column:
    one = lambda c: F.struct(F.coalesce(nested(c, "function", "name"), F.lit("")).alias("name"), F.coalesce(nested(c, "function", "arguments"), F.lit("{}")).alias("arguments"))
    return F.transform(F.filter(items_of(calls), is_object), one).cast(CALLS)


def answer_parts(payload: Column) -> Column:
    """struct(text, reasoning, calls, markup) of an answer in JSON: a list of typed parts under ``answer``, or the first of ``choices``.

    Texts and reasonings are joined as they are. ``markup``: the calls were found in the text, as the answer lists none; they are
    taken out of it. A null payload, or one of another form, says nothing.
    """
    parts = F.filter(items_of(nested(payload, "answer")), is_object)
    of = lambda ps, kind: F.filter(ps, lambda p: nested(p, "type") == kind)
    values = lambda ps, kind: F.array_join(F.transform(of(ps, kind), lambda p: F.coalesce(nested(p, "value"), F.lit(""))), "")
    listed = let(parts, lambda ps: F.struct(values(ps, "text").alias("text"), values(ps, "reasoning").alias("reasoning"), F.flatten(F.transform(of(ps, "tool_calls"), lambda p: _listed_calls(nested(p, "tool_calls")))).alias("calls")))
    message = nested(F.get(items_of(nested(payload, "choices")), F.lit(0)), "message")
    chosen = let(message, lambda m: F.struct(F.coalesce(nested(m, "content"), F.lit("")).alias("text"), F.coalesce(nested(m, "reasoning_content"), F.lit("")).alias("reasoning"), _listed_calls(nested(m, "tool_calls")).alias("calls")))
    either = F.when(F.coalesce(F.ltrim(nested(payload, "answer")).startswith("["), F.lit(False)), listed).otherwise(chosen)

    def whole(a: Column) -> Column:
        return F.when(F.size(a["calls"]) > 0, F.struct(a["text"].alias("text"), a["reasoning"].alias("reasoning"), a["calls"].alias("calls"), F.lit(False).alias("markup"))).otherwise(
            let(recovered(a["text"]), lambda r: F.struct(r["text"].alias("text"), a["reasoning"].alias("reasoning"), r["calls"].alias("calls"), (F.size(r["calls"]) > 0).alias("markup")))
        )

    return let(either, whole)
