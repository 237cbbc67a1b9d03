"""Test names, output, diffs and traces."""

import json

from pyspark.sql import functions as F

from trajspark.functions import testout as to
from trajspark.sources import traces


def one(spark, column, value):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], "v string").select(column).collect()]


def test_names(spark):
    names = ["a/test_x.py::TestA::test_foo[True]", "test_bar (m.C)", "mod.Class.method", "\x1b[31mtest_q - AssertionError: test_other", None, "run"]
    assert one(spark, to.bare_test_name(F.col("v")), names) == ["test_foo", "test_bar", "method", "test_q", "", "run"]
    assert one(spark, to.selectors(F.col("v")), ['["a", " a ", "b", ""]', "plain", None]) == [["a", "b"], ["plain"], []]
    assert one(spark, to.django_labels(F.array(F.col("v"), F.lit("x::y"))), ["test_a (m.C)", "test_a (m.C.test_a)"]) == [["m.C.test_a"], ["m.C.test_a"]]


def test_output(spark):
    raw = "ok\n\x1b[31ma.py::test_foo_bar FAILED\x1b[0m\nb.py::test_x[1] PASSED\n"
    found = F.array(F.lit("a.py::test_foo"), F.lit("b.py::test_x"))
    assert one(spark, to.has_selected_failure(F.col("v"), found), [raw, raw.replace("foo_bar", "foo"), None]) == [False, True, False]
    seen = one(spark, to.observed_selectors(F.col("v"), found), [raw])[0]
    assert (seen.observed, seen.missing) == (["b.py::test_x"], ["a.py::test_foo"])
    assert one(spark, to.has_zero_tests(F.col("v")), ["No tests ran in 0.1s", "10 passed", "0 passed", None]) == [True, False, True, False]
    assert one(spark, to.has_signature_failure(F.col("v")), ["TypeError: f() got an unexpected keyword argument 'x'", "TypeError: no"]) == [True, False]
    shown = "FAIL: test_a (m.C)\nx\nERROR: test_b (m.C)\ndocstring of b\n"
    assert one(spark, to.described_failures(F.col("v"), F.array(F.lit("docstring of b"))), [shown]) == [["test_a", "test_b"]]
    assert one(spark, to.marked_lines(F.col("v"), "FIX:"), ["a\nFIX: one \nFIX:two"]) == [["one", "two"]]


def test_paths(spark):
    got = one(spark, to.test_file_reason(F.col("v")), ["a/tests/b.py", "a/test_b.py", "./x_test.py", "r2e_tests/q.py", "lib/conftest.py", "a/my_runner.py", "a/b.py"])
    assert got == ["a/tests/**", "a/test_*.py", "*_test.py", "r2e_tests/**", "conftest.py", "*_runner.py", None]


def test_selected_traces(spark):
    t = spark.createDataFrame([([("tests/test_a.py", "test_a[1]")],), ([("tests/test_a.py", "setUp")],), ([("a.py", "test_a")],)], "frames array<struct<file_path:string,func_name:string>>")
    assert [r[0] for r in t.select(to.starts_in_selected_test(F.col("frames"), F.array(F.lit("test_a")))).collect()] == [True, True, False]


def test_diff(spark):
    line = lambda t, c: {"type": t, "content": c}
    hunk = {"descriptor": {"old_range": {"start": 1, "length": 2}, "new_range": {"start": 1, "length": 2}, "section": "def f"}, "line_group": {"all_lines": [line("context", "a"), line("deleted", "b"), line("added", "c"), line("note", "n")]}}
    diff = lambda p: {"header": {"file": {"path": p}}, "hunks": [hunk]}
    raw = json.dumps({"file_diffs": [diff("x.py"), diff("tests/x.py"), diff("x.md")]})
    assert one(spark, to.unified_diff(F.col("v")), [raw, "no", None]) == ["diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@ def f\n a\n-b\n+c", "", ""]
    assert one(spark, to.snippet(F.col("v"), F.lit(2), F.lit(3)), ["a\nb\nc\nd"]) == ["b\nc"]
    assert one(spark, to.preview(F.col("v"), 3), ["abc", "ab cd"]) == ["abc", "ab\n..."]


CALLABLES = "file_path string, start_line int, end_line int"


def test_trace_lines(spark, tmp_path):
    frame = lambda f, n: {"file": f, "line": n, "name": "g", "code": "x"}
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join([json.dumps({"frames": [frame("/repo/t.py", 1), frame("/repo/a.py", 5)]}), "broken {", json.dumps({"frames": []}), json.dumps({"frames": [frame("/repo/a.py", 50)]})]))
    c = spark.createDataFrame([("a.py", 4, 6)], CALLABLES)
    got = traces.scan_trace_lines(spark, str(p), c, "/repo").orderBy("trace_idx", "frame_idx").collect()
    assert [(r.file_path, r.line_no, r.is_patched) for r in got] == [("t.py", 1, False), ("a.py", 5, True)]
    assert traces.scan_trace_lines(spark, str(p), c, "/repo", require_patched=False).count() == 3


def test_trace_blocks(spark):
    block = "<<<FAULT_TRACE_BEGIN:f:a.py:1>>>\n/repo/t.py:1:g:x: y\n/repo/.venv/z.py:2:h:\n/repo/a.py:5:k:z\nbad\n<<<FAULT_TRACE_END>>>\n"
    logs = spark.createDataFrame([(1, "noise\n" + block), (2, None)], "log_id long, output string")
    got = traces.traces_in_logs(logs, spark.createDataFrame([("a.py", 4, 6)], CALLABLES), "/repo").orderBy("frame_idx").collect()
    assert [(r.file_path, r.line_no, r.is_patched, r.line_content) for r in got] == [("t.py", 1, False, "x: y"), ("a.py", 5, True, "z")]
