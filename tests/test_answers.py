"""Answers of models: typed parts, choices, and calls written into the text."""

import json

from pyspark.sql import functions as F

from trajspark.functions import answers, objects

A = '<｜｜DSML｜｜tool_calls><｜｜DSML｜｜invoke name="edit"><｜｜DSML｜｜parameter name="path" string="true"> a.py </｜｜DSML｜｜parameter><｜｜DSML｜｜parameter name="range" string="false">[1, 2]</｜｜DSML｜｜parameter><｜｜DSML｜｜parameter name="n">7</｜｜DSML｜｜parameter></｜｜DSML｜｜invoke></｜｜DSML｜｜tool_calls>'
B = '<minimax:tool_call><invoke name="run"><parameter name="cmd">ls "x"</parameter><parameter name="n">7</parameter><parameter name="n">8</parameter></invoke><invoke name="two">'


def parts(spark, *payloads):
    df = spark.createDataFrame([(json.dumps(p) if isinstance(p, dict) else p,) for p in payloads], "p string")
    return [(r.a.text, r.a.reasoning, [(c.name, json.loads(c.arguments)) for c in r.a.calls], r.a.markup) for r in df.select(answers.answer_parts(F.col("p")).alias("a")).collect()]


def test_answers(spark):
    call = {"id": "1", "function": {"name": "f", "arguments": {"x": 1}}}
    got = parts(
        spark,
        {"answer": [{"type": "reasoning", "value": "why"}, {"type": "text", "value": "a "}, 5, {"type": "text", "value": "b"}, {"type": "tool_calls", "tool_calls": [call, "no"]}]},
        {"choices": [{"message": {"content": "c", "reasoning_content": "r", "tool_calls": [{"function": {"name": "g", "arguments": '{"y": 2}'}}]}}]},
        {"choices": [{"message": {"content": f"first {A} last"}}]},
        {"answer": [{"type": "text", "value": f"go {B}"}]},
        {"answer": []}, {"choices": []}, {}, None, "no json",
    )
    nothing = ("", "", [], False)
    assert got == [
        ("a b", "why", [("f", {"x": 1})], False),
        ("c", "r", [("g", {"y": 2})], False),
        ("first  last", "", [("edit", {"path": "a.py", "range": [1, 2], "n": "7"})], True),
        ("go", "", [("run", {"cmd": 'ls "x"', "n": 8}), ("two", {})], True),
        nothing, nothing, nothing, nothing, nothing,
    ]


def test_a_listed_call_leaves_the_text(spark):
    assert parts(spark, {"choices": [{"message": {"content": A, "tool_calls": [{"function": {"name": "g"}}]}}]}) == [(A, "", [("g", {})], False)]


def test_deep(spark):
    """Strings that hold JSON, at each level, are decoded; others stay."""
    inner = {"k": json.dumps({"z": json.dumps([1, {"w": "{not json}"}])}), "s": "[plain", "n": None}
    df = spark.createDataFrame([(json.dumps({"a": json.dumps(inner), "b": [json.dumps({"c": 1}), "x \"y\""]}),), ("[]",), ("not json",)], "t string")
    got = [r[0] for r in df.select(F.to_json(objects.deep(F.try_parse_json("t")))).collect()]
    assert json.loads(got[0]) == {"a": {"k": {"z": [1, {"w": "{not json}"}]}, "s": "[plain", "n": None}, "b": [{"c": 1}, 'x "y"']}
    assert got[1:] == ["[]", None]


def test_strings_that_hold_json_at_each_level(spark):
    """A record whose containers, lists and steps are strings of JSON is the same record."""
    from trajspark.plans import scoring

    step = {"tool_calls": [{"function": {"name": "str_replace_editor", "arguments": {"command": "view", "path": "a.py"}}}]}
    text = json.loads(json.dumps(step))
    text["tool_calls"][0]["function"]["arguments"] = json.dumps(step["tool_calls"][0]["function"]["arguments"])
    records = [
        {"extra_info": {"instance_id": "p__1", "data_source": "d", "step": 3, "p2a_step_traces": [step]}},
        {"extra_info": json.dumps({"instance_id": "p__1", "data_source": "d", "step": "3", "p2a_step_traces": json.dumps([json.dumps(text)])})},
        {"extra_info": {"instance_id": "p__1", "data_source": "d", "step": 3.0, "p2a_step_traces": json.dumps({"steps": [json.dumps(text)]})}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "record_index long, raw string")
    rows = [(r.instance_id, r.data_source, r.run_step, [(s.family, s.target, s.reads, s.core) for s in r.steps]) for r in scoring.parse(df).orderBy("record_index").collect()]
    assert rows[0] == rows[1] == rows[2] and rows[0][:3] == ("p__1", "d", 3) and rows[0][3][0][:2] == ("read", "a.py")
