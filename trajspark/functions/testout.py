"""Test names, output of test runs, diffs and sources, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixtures that run for every test, folders and files of tests, words of results.
FIXTURES = ("setUp", "tearDown", "setUpClass", "tearDownClass", "asyncSetUp", "asyncTearDown")
ANSI = r"\x1b\[[0-9;]*m"
DISPLAY = r"^([A-Za-z_][A-Za-z0-9_]*)\s+\(([^)]+)\)$"
TEST_NAME = r"(?<![A-Za-z0-9_])(test[A-Za-z0-9_]*)(?=$|[^A-Za-z0-9_])"
FAILED_HEADER = r"^(?:FAIL|ERROR):\s+([A-Za-z_][A-Za-z0-9_]*)\s+\(([^)]+)\)\s*$"
SIGNATURE_ERROR = r"TypeError: .*(got an unexpected keyword argument|missing .*required positional argument|takes .*positional arguments?)"
ZERO_TESTS = r"(?i)\bno tests? (?:ran|run|collected)\b|\b0 (?:tests? )?passed\b"
RESULT_LINE = r"\b(PASSED|FAILED|ERROR|FAIL|ok)\b"
FAILURE_WORD = r"\b(FAILED|ERROR|FAIL)\b"


def plain_lines(raw: Column) -> Column:
    """Lines without colour codes; null has none."""
    return F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), ANSI, ""), r"\r\n|\n|\r")


def bare_test_name(name: Column) -> Column:
    """The function's name in a node id, a display name ``method (class)`` or a line of a summary, without parameters."""
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), ANSI, ""))
    head = F.substring_index(clean, " - ", 1)
    tests = F.regexp_extract_all(head, F.lit(TEST_NAME), F.lit(1))
    tail = F.substring_index(F.substring_index(head, ".", -1), "::", -1)
    return F.when(clean.rlike(DISPLAY), F.regexp_extract(clean, DISPLAY, 1)).when(F.size(tests) > 0, F.try_element_at(tests, F.lit(-1))).otherwise(F.regexp_replace(tail, r"\[.*\]$", ""))


def selectors(raw: Column) -> Column:
    """Selectors of a JSON list (or of one plain selector): trimmed, not empty, each once, in order."""
    listed = F.when(F.ltrim(raw).startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))
    return F.coalesce(F.array_distinct(F.filter(F.transform(listed, lambda s: F.trim(s)), lambda s: s != "")), F.array().cast("array<string>"))


def django_labels(found: Column) -> Column:
    """``class.method`` labels of the display names ``method (class)`` among selectors, each once."""
    shown = F.filter(found, lambda s: s.rlike(DISPLAY))

    def label(s: Column) -> Column:
        method, owner = F.regexp_extract(s, DISPLAY, 1), F.regexp_extract(s, DISPLAY, 2)
        return F.when(F.substring_index(owner, ".", -1) == method, owner).otherwise(F.concat_ws(".", owner, method))

    return F.array_distinct(F.transform(shown, label))


def line_names(line: Column, selector: Column) -> Column:
    """Whether a line names a selector: whole, its first occurrence not part of a longer name; or its bare name as a token of its own."""
    bare = bare_test_name(selector)
    at = F.instr(line, selector)
    whole = (selector != bare) & (at > 0) & ~F.substring(line, at + F.length(selector), F.lit(1)).rlike("^[A-Za-z0-9_]")
    token = F.regexp_like(line, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), bare, F.lit(r"\E(?:\[[^\]]+\])?(?![A-Za-z0-9_])")))
    return (selector != "") & (whole | ((bare != "") & token))


def has_selected_failure(raw: Column, found: Column) -> Column:
    bad = F.filter(plain_lines(raw), lambda s: s.rlike(FAILURE_WORD))
    return F.exists(found, lambda n: F.exists(bad, lambda s: line_names(s, n)))


def observed_selectors(raw: Column, found: Column) -> Column:
    """struct(observed, missing): selectors that some line with a result names, and the others."""
    results = F.filter(plain_lines(raw), lambda s: s.rlike(RESULT_LINE))
    seen = F.filter(found, lambda n: F.exists(results, lambda s: line_names(s, n)))
    return F.struct(seen.alias("observed"), F.filter(found, lambda n: ~F.array_contains(seen, n)).alias("missing"))


def has_signature_failure(raw: Column) -> Column:
    return F.exists(plain_lines(raw), lambda s: s.rlike(SIGNATURE_ERROR))


def has_zero_tests(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), ANSI, "").rlike(ZERO_TESTS)


def described_failures(raw: Column, found: Column) -> Column:
    """Methods of unittest failure headers that a selector names, by itself or in the header's five lines; sorted."""
    lines = F.transform(plain_lines(raw), lambda s: F.trim(s))

    def method(s: Column, i: Column) -> Column:
        name, owner = F.regexp_extract(s, FAILED_HEADER, 1), F.regexp_extract(s, FAILED_HEADER, 2)
        near = F.array_join(F.slice(lines, i + F.lit(1), F.lit(5)), "\n")
        hit = F.exists(found, lambda n: (n == F.concat(name, F.lit(" ("), owner, F.lit(")"))) | (bare_test_name(n) == name) | F.contains(near, n))
        return F.when(s.rlike(FAILED_HEADER) & hit, name)

    return F.array_sort(F.array_distinct(F.filter(F.transform(lines, method), lambda m: m.isNotNull())))


def starts_in_selected_test(frames: Column, names: Column, is_test: Column | None = None) -> Column:
    """Whether a trace (array<struct<file_path, func_name, ...>>) has a test-file frame of a named test or of a fixture; no names: false."""
    from .text import is_test_file

    def hit(f: Column) -> Column:
        bare = bare_test_name(f["func_name"])
        return is_test_file(f["file_path"]) & (F.array_contains(names, bare) | bare.isin(*FIXTURES))

    return (F.size(names) > 0) & F.exists(frames, hit)


def test_file_reason(path: Column) -> Column:
    """The pattern that makes a path a test: its suite's folder, or the kind of file; null for other files."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", "")
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    folder, prefix, suffix = (lambda x: x.isin("tests", "test", "testing")), (lambda x: x.startswith("test_")), (lambda x: x.endswith("_test.py"))
    places = F.transform(parts, lambda x, i: F.when(folder(x) | prefix(x) | suffix(x), i))
    at = F.array_min(F.filter(places, lambda i: i.isNotNull()))
    part = F.get(parts, at)
    before = F.slice(parts, F.lit(1), F.coalesce(at, F.lit(0)))
    mark = F.when(folder(part), F.concat(part, F.lit("/**"))).when(prefix(part), F.lit("test_*.py")).otherwise("*_test.py")
    reason = (
        F.when(p.startswith("r2e_tests/"), "r2e_tests/**").when(p.startswith("django/test/"), "django/test/**")
        .when(at.isNotNull(), F.array_join(F.array_append(before, mark), "/"))
        .when(name.isin("test.py", "tests.py", "conftest.py", "pytest_plugin.py", "pytest_plugins.py"), name).when(name.endswith("_runner.py"), "*_runner.py")
    )
    # All patterns but the last hold this word; most paths need not be taken apart.
    return F.when(path.contains("test") | path.endswith("_runner.py"), reason)


RANGE = "struct<start:int,length:int>"
DIFFS = f"array<struct<header:struct<file:struct<path:string>>,minus_file:struct<path:string>,plus_file:struct<path:string>,hunks:array<struct<descriptor:struct<old_range:{RANGE},new_range:{RANGE},section:string>,line_group:struct<all_lines:array<struct<content:string,type:string>>>>>>>"


def unified_diff(commit: Column, relevant: Column | None = None) -> Column:
    """Unified diff text of a commit's structured file diffs (JSON), for its .py files that are no tests, or those of ``relevant`` (an array)."""
    from .text import is_test_file

    diffs = F.coalesce(F.from_json(F.get_json_object(commit, "$.file_diffs"), DIFFS), F.array().cast(DIFFS))
    path = lambda d: F.coalesce(d["header"]["file"]["path"], F.lit(""))
    wanted = lambda d: path(d).endswith(".py") & (F.size(d["hunks"]) > 0) & (~is_test_file(path(d)) if relevant is None else F.coalesce(F.array_contains(relevant, path(d)), ~is_test_file(path(d))))
    count = lambda r: F.concat_ws(",", F.coalesce(r["start"], F.lit(0)), F.coalesce(r["length"], F.lit(0)))
    sign = lambda t: F.when(F.coalesce(t, F.lit("context")) == "context", " ").when(t == "deleted", "-").when(t == "added", "+")

    def hunk(h: Column) -> Column:
        d = h["descriptor"]
        lines = F.filter(F.transform(h["line_group"]["all_lines"], lambda x: F.concat(sign(x["type"]), F.coalesce(x["content"], F.lit("")))), lambda x: x.isNotNull())
        section = F.when(F.coalesce(d["section"], F.lit("")) != "", F.concat(F.lit(" "), d["section"])).otherwise("")
        return F.array_join(F.concat(F.array(F.concat(F.lit("@@ -"), count(d["old_range"]), F.lit(" +"), count(d["new_range"]), F.lit(" @@"), section)), F.coalesce(lines, F.array().cast("array<string>"))), "\n")

    def one(d: Column) -> Column:
        minus, plus = F.coalesce(d["minus_file"]["path"], F.concat(F.lit("a/"), path(d))), F.coalesce(d["plus_file"]["path"], F.concat(F.lit("b/"), path(d)))
        head = F.array(F.concat(F.lit("diff --git "), minus, F.lit(" "), plus), F.concat(F.lit("--- "), minus), F.concat(F.lit("+++ "), plus))
        return F.array_join(F.concat(head, F.transform(d["hunks"], hunk)), "\n")

    return F.array_join(F.transform(F.filter(diffs, wanted), one), "\n")


def snippet(source: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a source, both included and counted from 1."""
    return F.array_join(F.slice(F.split(source, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def preview(source: Column, size: int = 500) -> Column:
    """The first characters of a source; a cut one ends in dots on a line of their own."""
    return F.when(F.length(source) > size, F.concat(F.rtrim(F.substring(source, 1, size)), F.lit("\n..."))).otherwise(source)


def marked_lines(output: Column, mark: str) -> Column:
    """What follows a marker on the lines that begin with it."""
    return F.transform(F.filter(plain_lines(output), lambda s: s.startswith(mark)), lambda s: F.trim(F.substring(s, len(mark) + 1, 1 << 30)))
