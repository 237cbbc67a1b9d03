"""File reads in tool calls and free text, extracted with regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .objects import let
from .text import normalize_path

READ = "array<struct<file_path:string,start_line:int,end_line:int>>"
WHOLE = 999_999
HEAD_LINES = 50
#: What each command or call looks like. (?U): Unicode classes as elsewhere.
PATH = r"([^\s|><;`$&]+\.py\b)"
CAT = rf"(?U)\bcat\s+(?:-[nAbeEstTv]+\s+)*{PATH}"
HEAD_TAIL = rf"(?U)\b(head|tail)\s+(?:-(?:n\s*)?(\d+)\s+)?{PATH}"
SED = rf"(?U)\bsed\s+-n\s+['\"]?(\d+),(\d+)p['\"]?\s+{PATH}"
GREP_N = rf"(?U)\bgrep\s+(?:-[A-Za-z]*n[A-Za-z]*\s+)(?:['\"][^'\"]*['\"]\s+|[^\s]+\s+){PATH}"
GREP = rf"(?U)\bgrep\s+(?:-[A-Za-z]+\s+)*(?:['\"][^'\"]*['\"]\s+|[^\s]+\s+){PATH}"
BASH_XML = r'(?s)<function=execute_bash>.*?<parameter\s*(?:name=)?"?command"?>([^<]+)</parameter>'
BASH_EQ = r"(?s)<function=execute_bash>.*?<parameter=command>([^<]+)</parameter>"
BASH_JSON = r'(?s)<function=execute_bash>\s*(\{[^}]*"command"\s*:[^}]*\})'
VIEW_JSON = r'(?s)<function=file_editor>\s*(\{[^}]*"command"\s*:\s*"view"[^}]*\})'
VIEW_XML = r'(?s)<function=file_editor>.*?<parameter name="command">view</parameter>.*?<parameter name="path">([^<]+)</parameter>(?:.*?<parameter name="view_range">\[(\d+),\s*(\d+)\]</parameter>)?'
VIEW_EQ = r"(?s)<function=file_editor>.*?<parameter=command>view</parameter>.*?<parameter=path>([^<]+)</parameter>(?:.*?<parameter=view_range>\[(\d+),\s*(\d+)\]</parameter>)?"
EDITOR_JSON = r'(?s)"name"\s*:\s*"str_replace_editor".*?"arguments"\s*:\s*(\{[^}]*"command"\s*:\s*"view"[^}]*\})'
EDITOR_TEXT = r"""(?s)str_replace_editor\s*\(\s*command\s*=\s*["']view["'].*?path\s*=\s*["']([^"']+)["'](?:.*?view_range\s*=\s*\[(\d+)\s*,\s*(-?\d+)\])?"""
VIEW_ARGS = "struct<command:string,path:string,view_range:array<int>>"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _read(path: Column, start: Column, end: Column) -> Column:
    return F.struct(normalize_path(path).alias("file_path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def _number(text: Column, otherwise: Column) -> Column:
    return F.coalesce(text.try_cast("int"), otherwise)


def reads_in_command(command: Column) -> Column:
    """Reads of one shell command, each once: cat, head and tail, sed -n, grep on .py files."""
    whole = lambda p: _read(p, F.lit(1), F.lit(WHOLE))
    part = lambda m, pattern, g: F.regexp_extract(m, pattern, g)
    found = [
        F.transform(_all(command, CAT), whole),
        F.transform(_all(command, HEAD_TAIL, 0), lambda m: _read(part(m, HEAD_TAIL, 3), F.lit(1), F.when(part(m, HEAD_TAIL, 1) == "head", _number(part(m, HEAD_TAIL, 2), F.lit(HEAD_LINES))).otherwise(WHOLE))),
        F.transform(_all(command, SED, 0), lambda m: _read(part(m, SED, 3), part(m, SED, 1).try_cast("int"), part(m, SED, 2).try_cast("int"))),
        F.transform(_all(command, GREP_N), whole),
        F.transform(_all(command, GREP), whole),
    ]
    return F.array_distinct(F.concat(*found))


def reads_in_bash(text: Column) -> Column:
    """Reads of the shell calls in a text; a text without any is itself taken for a command."""
    calls = F.concat(_all(text, BASH_XML), _all(text, BASH_EQ), F.filter(F.transform(_all(text, BASH_JSON), lambda j: F.get_json_object(j, "$.command")), lambda c: c.isNotNull() & (c != "")))
    commands = F.when(F.size(calls) == 0, F.array(text)).otherwise(calls)
    return F.array_distinct(F.flatten(F.transform(commands, lambda c: reads_in_command(F.trim(c)))))


def _json_views(text: Column, pattern: str, open_end: bool) -> Column:
    args = F.transform(_all(text, pattern), lambda j: F.from_json(j, VIEW_ARGS))
    ok = F.filter(args, lambda a: (a["command"] == "view") & a["path"].isNotNull())

    def one(a: Column) -> Column:
        ranged = F.size(a["view_range"]) == 2
        end = a["view_range"][1]
        end = F.when(end > 0, end).otherwise(WHOLE) if open_end else end
        return _read(a["path"], F.when(ranged, a["view_range"][0]).otherwise(1), F.when(ranged, end).otherwise(WHOLE))

    return F.transform(ok, one)


def _text_views(text: Column, pattern: str, open_end: bool) -> Column:
    def one(m: Column) -> Column:
        start, end = (F.regexp_extract(m, pattern, g).try_cast("int") for g in (2, 3))
        end = F.when(end > 0, end).when(end.isNotNull(), WHOLE) if open_end else end
        return _read(F.regexp_extract(m, pattern, 1), F.coalesce(start, F.lit(1)), F.coalesce(end, F.lit(WHOLE)))

    return F.transform(_all(text, pattern, 0), one)


def reads_in_text(text: Column, mode: str = "view_and_bash") -> Column:
    """All reads of a response text: editor views, then shell commands if ``mode`` counts them; null has none."""
    text = F.coalesce(text, F.lit(""))
    views = [_json_views(text, VIEW_JSON, False), _text_views(text, VIEW_XML, False), _text_views(text, VIEW_EQ, False), _json_views(text, EDITOR_JSON, True), _text_views(text, EDITOR_TEXT, True)]
    parts = views + ([reads_in_bash(text)] if mode == "view_and_bash" else [])
    return F.concat(*parts).cast(READ)


def reads_in_tool_calls(calls: Column) -> Column:
    """Reads of structured calls array<struct<name, arguments (JSON)>>: editor views and shell commands, whatever the mode."""
    none = F.array().cast(READ)

    def one(c: Column) -> Column:
        return let(F.from_json(c["arguments"], VIEW_ARGS), lambda a: of(c, a))

    def of(c: Column, a: Column) -> Column:
        ranged = F.size(a["view_range"]) == 2
        view = F.array(_read(a["path"], F.when(ranged, a["view_range"][0]).otherwise(1), F.when(ranged & (a["view_range"][1] > 0), a["view_range"][1]).otherwise(WHOLE))).cast(READ)
        editor = (c["name"] == "str_replace_editor") & (a["command"] == "view") & a["path"].isNotNull()
        command = F.get_json_object(c["arguments"], "$.command")
        shell = (c["name"] == "execute_bash") & (command != "")
        return F.when(editor, view).when(shell, let(command, lambda x: reads_in_command(x).cast(READ))).otherwise(none)

    return F.flatten(F.transform(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>")), one))
