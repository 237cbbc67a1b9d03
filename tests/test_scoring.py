"""Whole records scored against hand-worked values."""

import json

import pytest
from pyspark.sql import functions as F

from trajspark.functions import steps as st
from trajspark.plans import scoring
from trajspark.sources import records as src

NODES = [
    ("p__r-1", "n0", "a.py", 1, 10, 0.0, True, "root_cause"),
    ("p__r-1", "n1", "b.py", 1, 10, 0.5, True, "intermediate"),
    ("p__r-1", "n2", "c.py", 1, 10, 1.0, True, "symptom"),
    ("p__r-1", "h", "tests/t.py", 1, 10, 1.0, False, "test_harness"),
]
EDGES = [("p__r-1", "n2", "n1", True), ("p__r-1", "n1", "n0", True), ("p__r-1", "h", "n2", False)]
MAPS = [("p__r-1", "standard", None, ["n2"], ["n0"]), ("q__r-2", "no_gt", "no_gt", [], [])]


def view(path, lo=None, hi=None):
    args = {"command": "view", "path": path} | ({"view_range": [lo, hi]} if lo else {})
    return {"tool_calls": [{"function": {"name": "str_replace_editor", "arguments": json.dumps(args)}}]}


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.createDataFrame(NODES, "instance_id string, node_key string, file_path string, start_line int, end_line int, normalized_distance double, rewardable boolean, node_role string")
    edges = spark.createDataFrame(EDGES, "instance_id string, caller string, callee string, reward boolean")
    maps = spark.createDataFrame(MAPS, "map_id string, case_type string, reason_code string, anchors array<string>, roots array<string>")
    return maps, nodes, edges


def score(spark, tables, *records):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "record_index long, raw string")
    return {r.record_index: r for r in scoring.score_records(df, *tables).collect()}


def test_scores(spark, tables):
    steps = [view("/testbed/c.py", 1, 5), view("x.py"), {"response_text": "cat b.py"}, view("./a.py", 3, 4), view("a.py", 50, 60)]
    run = {"uid": "p__r-1", "extra_info": json.dumps({"data_source": "s", "global_step": 7}), "p2a_step_traces": steps}
    jump = {"instance_id": "p__r-1", "p2a_step_traces": {"steps": [view("a.py"), view("c.py")]}}
    flat = {"instance_id": "p__r-1", "response_text": "cat a.py"}
    none = {"instance_id": "other"}
    got = score(spark, tables, run, jump, flat, none, {"instance_id": "q__r-2"})
    assert len(got) == 5
    r = got[0]
    assert (r.instance_id, r.data_source, r.run_step, r.n_reads, r.n_steps_with_reads) == ("p__r-1", "s", 7, 5, 5)
    assert (r.min_distance, r.n_hit_nodes, r.hit_precision, r.hit_recall, r.hit_f1) == (0.0, 3, 0.6, 1.0, pytest.approx(0.75))
    assert (r.first_hit_step, r.first_ground_truth_step, r.order_score, r.miracle_step, r.miracle_severity) == (0, 3, 1.0, False, 0)
    assert (r.chain_evaluable, r.n_chain_nodes, r.n_context_nodes, r.chain_node_recall, r.chain_read_precision) == (True, 3, 1, 1.0, 0.6)
    assert (r.first_anchor_step, r.first_root_step, r.steps_anchor_to_root, r.anchor_before_root) == (0, 3, 3, True)
    assert (r.n_blocks, r.n_scored_read_blocks, r.n_achieving_blocks, r.n_wasted_blocks) == (4, 3, 2, 1)
    assert not any(getattr(r, k) for k in ("missed_anchor", "missed_root_after_anchor", "root_before_anchor", "chain_stall", "off_chain_read_spree", "error_spiral_on_chain"))
    j = got[1]
    assert (j.order_score, j.miracle_step, j.miracle_severity, j.root_before_anchor, j.anchor_before_root, j.missed_root_after_anchor) == (-1.0, True, 1, True, False, True)
    f = got[2]
    assert (f.has_step_traces, f.first_hit_step, f.first_ground_truth_step, f.first_root_step, f.missed_anchor) == (False, 0, 0, 0, True)
    n = got[3]
    assert (n.has_bonus_map, n.min_distance, n.not_chain_evaluable_reason, n.data_source, n.best_positive_multiplier) == (False, None, "missing_bonus_map", "unknown", 1.0)
    assert (got[4].has_bonus_map, got[4].not_chain_evaluable_reason, got[4].has_call_graph) == (True, "no_gt", False)


def test_summary(spark, tables):
    df = spark.createDataFrame([(0, json.dumps({"instance_id": "p__r-1", "p2a_step_traces": [view("a.py")]})), (1, json.dumps({"id": "none"}))], "record_index long, raw string")
    details = scoring.score_records(df, *tables)
    s = scoring.summarise(details).first()
    assert (s.n_records, s.n_with_map, s.n_hit, s.hit_rate, s.reverse_rate, s.chain_hit_rate, s.achieve_rate) == (2, 1, 1, 1.0, None, 1.0, 1.0)
    assert {r.case_type: r.n_records for r in scoring.case_summary(details).collect()} == {"standard": 1, "missing_bonus_map": 1}
    assert scoring.score_records(df.limit(0), *tables).count() == 0


def test_ids(spark):
    rows = [{"uid": "plain", "metadata": {"instance_id": " m "}}, {"task_id": "a__b"}, {"instance_id": 5, "id": "x__y"}, {"reward": json.dumps({"metadata": {"instance_id": "deep"}})}, {}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")
    assert [r[0] for r in df.select(src.instance_id(F.col("raw"))).collect()] == ["m", "a__b", "x__y", "deep", None]
    steps = [{"global_step": True, "step": "12.7"}, {"metadata": {"iteration": 3}}, {"step": "nan", "extra_info": {"step": 4}}, {"step": "inf"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in steps], "raw string")
    assert [r[0] for r in df.select(src.run_step(F.col("raw"))).collect()] == [12, 3, 4, None]


def test_tool_calls(spark):
    rows = [
        [{"function": {"name": "f", "arguments": {"a": 1}}}, {"name": "g", "args": "{}"}, {"tool_name": "h"}, 5, {"x": 1}],
        {"tool_calls": [{"name": "g", "arguments": {}}]},
        {"tool_name": "h"},
        "text",
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")
    assert [[c.name for c in r[0]] for r in df.select(st.tool_calls(F.col("raw"))).collect()] == [["f", "g", "h"], ["g"], ["h"], []]


def test_content_and_messages(spark):
    m = {"messages": [{"role": "user", "content": "cat no.py"}, {"role": "Assistant", "content": [{"type": "t", "text": "cat a.py"}, "cat b.py", {"content": "x"}]}, {"role": "tool", "tool_calls": [view("c.py")["tool_calls"][0]]}]}
    df = spark.createDataFrame([(json.dumps(m),)], "raw string")
    assert [r.file_path for r in st.with_reads(df, "raw").first().reads] == ["c.py", "a.py", "b.py"]


def test_actions(spark):
    call = lambda n, **a: json.dumps({"tool_calls": [{"function": {"name": n, "arguments": a}}]})
    rows = [call("file_editor", command="view", path="/testbed/a.py"), call("file_editor", command="create", path="a.py"), call("execute_bash", command="cat a.py"), call("execute_bash", command="cat a.py b.py; cat c.py"), call("execute_bash", command="ls"), call("finish"), "{}", "text", None]
    df = spark.createDataFrame([(r,) for r in rows], "step string")
    got = [(r.a.family, r.a.target) for r in df.select(st.action(F.col("step")).alias("a")).collect()]
    assert got == [("read", "a.py"), ("edit", "a.py"), ("read", "a.py"), ("read", None), ("exec", None), ("other", None), ("other", None), ("other", None), ("other", None)]


def test_errors():
    assert st.error_in('{"a": "an Error here"}') and st.error_in("it failed")
    assert not st.error_in("{}") and not st.error_in(None) and not st.error_in("errors") and not st.error_in('{"a": "x\\nerror"}')
    assert not st.error_in('{"a": "' + "x" * 6000 + ' error"}')


def test_native_calls(spark):
    text = '<call><invoke name="f"><parameter name="x">1</parameter><parameter name="y"> two </parameter></invoke></call> rest'
    df = spark.createDataFrame([(text,), ("none",)], "t string")
    p = r'<parameter name="([^"]+)">([\s\S]*?)</parameter>'
    got = [[(c.name, json.loads(c.arguments)) for c in r[0]] for r in df.select(st.native_calls(F.col("t"), r"<call>([\s\S]*?)</call>", r'<invoke name="([^"]+)">([\s\S]*?)</invoke>', p)).collect()]
    assert got == [[("f", {"x": "1", "y": "two"})], []]
