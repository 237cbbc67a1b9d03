"""Case types, anchors, reports."""

from pyspark.sql import functions as F

from trajspark.functions import anchors
from trajspark.operators import aggregates
from trajspark.plans import casetype, report

COLS = "instance_id string, n_callables int, n_new_callables int, state_matches boolean, n_instrumented int, exit_code int, f2p_failed boolean, zero_tests boolean, signature_error boolean, n_traces int, n_patched_traces int, n_f2p_traces int, cap_reached boolean, max_rewardable_distance double, exception string"


def test_case_types(spark):
    base = dict(n_callables=1, n_new_callables=0, state_matches=True, n_instrumented=1, exit_code=1, f2p_failed=True, zero_tests=False, signature_error=False, n_traces=2, n_patched_traces=2, n_f2p_traces=1, cap_reached=False, max_rewardable_distance=1.0, exception=None)
    cases = {
        "standard": {}, "direct": {"max_rewardable_distance": 0.0}, "newly_created": {"n_callables": 0, "n_new_callables": 2}, "no_callable": {"n_callables": 0}, "instrumentation_failed": {"n_instrumented": 0},
        "signature_mismatch": {"n_traces": 0, "signature_error": True}, "no_trace": {"n_traces": 0}, "no_gt": {"n_patched_traces": 0}, "trace_cap_inconclusive": {"n_f2p_traces": 0, "cap_reached": True}, "no_f2p": {"n_f2p_traces": 0}, "precompute_failed": {"exception": "x"},
    }
    df = spark.createDataFrame([(k, *(base | v).values()) for k, v in cases.items()], COLS)
    got = casetype.case_type(df).select("instance_id", "case_type", "reason_code").collect()
    assert all(r.instance_id == r.case_type for r in got)
    assert {r.reason_code for r in got if r.case_type == "no_trace"} == {"no_trace_exit_one"}


def test_build_selection(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "instance_id string")
    skips, maps = tasks.where("instance_id = 'a'"), spark.createDataFrame([("b", "standard", "standard"), ("c", "precompute_failed", "exception")], "instance_id string, case_type string, reason_code string")
    assert {r.instance_id for r in casetype.to_build(tasks, skips, maps).collect()} == {"c", "d"}


def test_selectors(spark):
    row = spark.createDataFrame([("a.py::test_foo_bar FAILED", "a.py::test_foo"), ("a.py::test_foo FAILED", "a.py::test_foo")], "line string, s string")
    assert [r.x for r in row.select(casetype.selector_found(F.col("line"), F.col("s")).alias("x")).collect()] == [False, True]


def test_anchors(spark):
    issues = spark.createDataFrame([("i", "Calling `app.views.symptom` fails in pkg/mod.py: get() and Thing.method(x)"), ("j", None)], "instance_id string, issue_text string")
    a = anchors.issue_anchors(issues)
    assert {("backtick", "app.views.symptom"), ("file_path", "pkg/mod.py"), ("dotted_name", "Thing.method")} <= {(r.kind, r.value) for r in a.collect()}
    assert "get" not in {r.value for r in a.collect()}
    frames = spark.createDataFrame([("i", 0, k, "app/views.py", q, q.split(".")[-1]) for k, q in enumerate(["dispatch", "views.symptom", "symptom", "helper"])], "instance_id string, trace_idx int, frame_idx int, file_path string, qualified_name string, func_name string")
    # A frame's name has to end in the whole dotted name to score 90; here only the last part agrees.
    assert [(r.frame_idx, r.score) for r in anchors.select_anchors(frames, a).collect()] == [(2, 60)]


def test_callable_changes(spark):
    cols = "file_path string, qualified_name string, source string"
    old, new = spark.createDataFrame([("a", "f", "1"), ("a", "g", "1")], cols), spark.createDataFrame([("a", "f", "2"), ("a", "g", "1"), ("a", "h", "1")], cols)
    assert [r.qualified_name for r in casetype.modified_callables(old, new).collect()] == ["f"]
    assert [r.qualified_name for r in casetype.new_callables(old, new).collect()] == ["h"]


def test_reports(spark):
    d = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, 0.5)], "record_index long, min_distance double")
    summary = aggregates.hit_rates(d)
    assert summary.first().hit_ground_truth_rate == 0.333333
    text = report.markdown(summary, d)
    assert "n_records: 3" in text and text.count("\n| 1 |") == 1
    assert "<td>1</td>" in report.html_page("t", d, "record_index")
    assert report.terminal(spark.createDataFrame([], "model_label string, resolved_rate double, place int")) == "No evaluation rows found."
    usage = casetype.token_usage(spark.createDataFrame([("r", 1, None, 2, None, None, 0.5), ("r", None, 3, None, 4, 5, None)], "run_id string, input_tokens int, prompt_tokens int, output_tokens int, completion_tokens int, cache_hit_tokens int, cost double"))
    assert tuple(usage.first()) == ("r", 4, 6, 5, 0.5)
