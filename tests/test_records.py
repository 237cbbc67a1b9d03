"""Call graphs, anchors, cache tables, registries, rollouts and credit against known values."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from trajspark.functions import anchors, tasks, text
from trajspark.operators import credit, overlap
from trajspark.plans import cache, callgraph, rollout, summary
from trajspark.sources import registry
from trajspark.streaming import watch


def test_anchor_scores(spark):
    """Each rung of the ladder, and what does not match."""
    cases = [
        (100, "src/pkg/mod.py", "Thing.run", "pkg/mod.py", "Thing.run", "run"), (None, "src/pkg/mod.py", "Other.run", "pkg/mod.py", "Thing.run", "run"), (80, "pkg/mod.py", "Thing.go_value", "pkg/mod.py", None, "go"),
        (30, "pkg/mod.py", "f", "pkg/mod.py", None, None), (None, "mod.py", "f", "mod.py", None, None), (None, "pkg/other.py", "f", "pkg/mod.py", None, None), (90, "a.py", "outer.<locals>.Thing.go", None, "Thing.go", "go"), (None, "a.py", "go", None, "Thing.Go", "Go"),
        (70, "a.py", "Thing.go", None, "pkg.Thing", "Thing"), (60, "a.py", "go", None, "Thing.go", "go"), (None, "a.py", "run", None, "thing.run", "run"), (50, "a.py", "x.go", None, None, "go"), (50, "a.py", "go_values", None, None, "go"), (50, "a.py", "run", None, None, "run"), (None, "a.py", "run_value", None, None, "run"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, want int, path string, own string, p string, q string, n string")
    got = df.select("i", "want", anchors.match_score(*map(F.col, ("path", "own", "p", "q", "n"))).alias("got")).collect()
    assert not [(r.i, r.want, r.got) for r in got if r.want != r.got]


def test_anchor_candidates(spark):
    issue = 'File "/src/a/b.py", line 3, in going\nFile "x.py", line 4, in <module>\n`pkg/m.py::K.func_b()` `two words` `run` `a/b.py:12` see lib/x.py:7 and os.path.join (x) get( do it'
    rows = anchors.candidates(spark.createDataFrame([("i", issue), ("j", " "), ("k", None)], "instance_id string, issue_text string")).collect()
    got = {(r.kind, r.file_path, r.qualified_name, r.name) for r in rows}
    # Closing brackets are stripped before a pair of them, so "func_b()" leaves an opening one; names of two letters don't count.
    assert got == {
        ("traceback_frame", "src/a/b.py", "going", "going"), ("backtick", "pkg/m.py", "K.func_b(", "func_b("), ("backtick", "a/b.py", None, None), ("file_path", "pkg/m.py", None, None), ("file_path", "a/b.py", None, None), ("file_path", "lib/x.py", None, None),
        ("dotted_name", "b.py", None, None), ("dotted_name", "m.py", None, None), ("dotted_name", "x.py", None, None), ("dotted_name", None, "K.func_b", "func_b"), ("dotted_name", None, "os.path.join", "join"),
    }


FRAMES = "instance_id string, trace_idx int, frame_idx int, file_path string, line_no int, func_name string, qualified_name string, is_patched boolean"


def test_call_graph(spark):
    """A cycle of two patched callables that nothing leaves: both are roots; frames before the anchor earn nothing."""
    path = [("tests/test_a.py", 1, "test_a", False), ("app/web.py", 5, "dispatch", False), ("app/api.py", 12, "Api.show", False), ("app/core.py", 21, "up", True), ("app/core.py", 31, "ping", True), ("app/core.py", 41, "pong", True), ("app/core.py", 32, "ping", True)]
    frames = spark.createDataFrame([("i", 0, k, f, n, q.split(".")[-1], q, p) for k, (f, n, q, p) in enumerate(path)] + [("j", 0, 0, "a.py", 1, "f", None, False)], FRAMES)
    modified = spark.createDataFrame([("i", "app/core.py", q, s, s + 5, "body") for q, s in (("up", 20), ("ping", 30), ("pong", 40), ("gone", 50))], "instance_id string, file_path string, qualified_name string, start_line int, end_line int, source string")
    issues = spark.createDataFrame([("i", "`Api.show` is wrong")], "instance_id string, issue_text string")
    callables = spark.createDataFrame([("i", "app/api.py", "Api", 10, 40, "class"), ("i", "app/api.py", "Api.show", 11, 15, "show"), ("i", "app/web.py", "other", 1, 9, "o"), ("i", "app/web.py", "inner", 4, 6, "x")], "instance_id string, file_path string, qualified_name string, start_line int, end_line int, source string")
    g = callgraph.build(frames, modified, issues, callables)
    nodes = {r.node_key.split("::")[1]: r for r in g.nodes.collect()}
    assert {k: (r.node_role, r.hop_distance, r.raw_hop_distance) for k, r in nodes.items()} == {
        "ping": ("root_cause", 0, 0), "pong": ("root_cause", 0, 0), "up": ("intermediate", 1, 1), "Api.show": ("symptom", 2, 2), "dispatch": ("pre_symptom", 2, 3), "test_a": ("test_harness", 2, 4),
    }
    assert (nodes["up"].start_line, nodes["Api.show"].start_line, nodes["Api.show"].source, nodes["dispatch"].start_line, nodes["dispatch"].source) == (20, 11, "show", 4, None)
    assert (nodes["test_a"].exclusion_reason, nodes["dispatch"].exclusion_reason) == ("test_suite_or_harness:tests/**", "pre_symptom")
    edges = {(r.caller.split("::")[1], r.callee.split("::")[1]): (r.reward_path_edge, r.direct_symptom_to_root_cause) for r in g.edges.collect()}
    assert edges[("Api.show", "up")] == (True, False) and edges[("dispatch", "Api.show")] == (False, False) and ("pong", "ping") in edges
    assert [r.qualified_name for r in g.unobserved.collect()] == ["gone"]
    assert {r.instance_id: (r.traceable, r.hop_max, r.reward_start_source) for r in g.summary.collect()} == {"i": (True, 2, "issue_anchor"), "j": (False, 0, "test_filtered_fallback")}
    moved = callgraph.relocated(modified, modified.where("qualified_name = 'up'").withColumn("start_line", F.lit(99)))
    assert [(r.qualified_name, r.start_line) for r in moved.collect()] == [("up", 99)]


def test_edge_pairs(spark):
    df = spark.createDataFrame([('[["a","b"],{"caller":"c","callee":"d"},["x"]]', '[{"caller":"e","callee":"f"}]'), ("[]", '[{"caller":"e","callee":"f"}]'), (None, None)], "a string, b string")
    assert [[tuple(p) for p in r.e] for r in df.select(callgraph.edge_pairs(F.col("a"), F.col("b")).alias("e")).collect()] == [[("a", "b"), ("c", "d")], [("e", "f")], []]


def test_pairs_across_bins(spark):
    """Ranges of all lengths, whole files and inverted ones against every pair."""
    import random

    rng = random.Random(2)
    reads = [("i", "f", a, a + rng.choice([0, 3, 40, 999_999, -5])) for a in rng.sample(range(1, 400), 60)]
    nodes = [("i", "f", a, a + rng.choice([0, 10, 90]), k) for k, a in enumerate(rng.sample(range(1, 300), 50))]
    r = spark.createDataFrame(reads, "instance_id string, file_path string, start_line int, end_line int")
    n = spark.createDataFrame(nodes, "instance_id string, file_path string, start_line int, end_line int, node_key int")
    got = sorted((x.start_line, x.end_line, x.node_key) for x in overlap._pairs(r, n).collect())
    assert got == sorted((a, b, k) for _, _, a, b in reads for _, _, s, e, k in nodes if a <= e and b >= s)


def test_registry_files(spark, tmp_path):
    assert registry.skip_registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text(json.dumps({"skip": [{"id": "r__1", "repo": "r", "reason": "x", "source": "report"}, {"id": "", "repo": "q"}]}, indent=1))
    held = registry.skip_registry(spark, str(tmp_path / "bad.json"))
    assert [r.id for r in registry.skip_ids(held).collect()] == ["r__1"]
    (tmp_path / "gate.jsonl").write_text('{"instance_id": "r__1", "gate_pass": true}\n{"instance_id": "a__2", "fixed": {"resolved": false}}\n{"gate_pass": true}\n')
    gates = registry.gate_results(spark, str(tmp_path / "gate.jsonl"))
    merged = registry.merge_gates(held.where("id <> ''"), gates, "gate", evidence="log")
    assert [(r.id, r.reason, r.evidence) for r in merged.collect()] == [("a__2", "fixed_did_not_pass_p2p", "log"), ("r__1", "x", None)]
    assert [r.id for r in registry.merge_gates(held.where("id <> ''"), gates, "gate", drop_passed_seeds=True, expected=2).collect()] == ["a__2"]
    registry.write_registry(merged, str(tmp_path / "out"))
    assert [r.id for r in registry.skip_registry(spark, str(tmp_path / "out")).collect()] == ["a__2", "r__1"]


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('{"records": [{"x": 1}, {"x": 2}, {"x": 3}]}')
    spark.range(4).write.parquet(str(tmp_path / "c.parquet"))
    assert [registry.load_rows(spark, str(tmp_path / f)).count() for f in ("a.jsonl", "b.json", "c.parquet")] == [2, 3, 4]
    assert registry.scan_parquet(spark, str(tmp_path / "c.parquet")).where("raw like '{\"id\":%'").count() == 4
    assert [r.value for r in registry.capped_lines(spark, str(tmp_path / "a.jsonl"), 1).collect()] == ['{"x": 1}']
    with pytest.raises(FileNotFoundError):
        registry.cached_dataset(spark, str(tmp_path), "o/n", "test")
    with sqlite3.connect(tmp_path / "t.db") as con:
        con.execute("CREATE TABLE run_cells (id INTEGER, status TEXT)")
        con.execute("INSERT INTO run_cells VALUES (1, 'done'), (2, NULL)")
    assert [tuple(r) for r in registry.sqlite_table(spark, str(tmp_path / "t.db"), "run_cells", "id long, status string").collect()] == [(1, "done"), (2, None)]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("a: {b: 2}\nd: [1]\n")
    assert rollout.load_config(tmp_path / "c.yaml", {"a": {"b": 1, "c": 3}, "e": 0}) == {"a": {"b": 2, "c": 3}, "d": [1], "e": 0}
    assert (rollout.parse_limit("ALL"), rollout.parse_limit(None, 5), rollout.parse_limit("7"), rollout.parse_limit(0)) == (None, 5, 7, 0)
    for bad in ("x", -1):
        with pytest.raises(ValueError, match="limit"):
            rollout.parse_limit(bad)
    assert [rollout.env_int(*a) for a in ((None, 3), ("x", 3), ("2", 3, 5), ("9", 3, 5))] == [3, 3, 3, 9]


def test_cache_tables(spark):
    empty = cache.create(spark, "t0")
    assert {k: v.count() for k, v in empty.items()} == {"schema_migrations": 1, "experiments": 0, "run_cells": 0, "raw_rollouts": 0, "quantitative_metrics": 0}
    key = "experiment_id string, provider_source string, model_api_name string, dataset string, instance_id string, model_label string"
    cells = cache.plan_cells(empty["run_cells"], spark.createDataFrame([("e", "p", "m", "d", i, "L") for i in ("a", "a", "b")], key), "t1")
    again = cache.plan_cells(cells, spark.createDataFrame([("e", "p", "m", "d", "a", "M")], key), "t2")
    assert {(r.instance_id, r.model_label, r.created_at, r.updated_at, r.status) for r in again.collect()} == {("a", "M", "t1", "t2", "pending"), ("b", "L", "t1", "t1", "pending")}
    assert cache.violations("run_cells", again).count() == 0 and cache.violations("run_cells", again.union(again)).count() == 2
    rows = [("a", {"run_id": "r1", "error": "x"}, 0), ("a", {"run_id": "r1", "reward": True, "trajectory": [1, 2]}, 1), ("b", {"reward": "no", "wall_time": 0, "execution_time": 4}, 2)]
    runs = spark.createDataFrame([("e", "p", "m", "d", i, "M", json.dumps(raw), k, None, None) for i, raw, k in rows], key + ", raw string, ingest_order int, artifact_rollouts string, artifact_details string")
    details = spark.createDataFrame([], "instance_id string, ingest_order int, n_reads int, hit_call_graph boolean, hit_ground_truth boolean, hit_near boolean, min_distance double")
    new_cells, raw, metrics = cache.ingest(again, empty["raw_rollouts"], empty["quantitative_metrics"], runs, details, "t3")
    assert {(r.instance_id, r.status, r.attempts, r.run_id) for r in new_cells.collect()} == {("a", "done", 2, "r1"), ("b", "done", 1, "e:p:m:d:b")}
    assert {r.run_id for r in raw.collect()} == {"r1", "e:p:m:d:b"}
    assert {(r.reward, r.turns, r.wall_time, r.p2a_read) for r in metrics.collect()} == {(1.0, 2, None, None), (None, 0, 4.0, None)}


def test_spanned_traces(spark):
    steps = [(1, "a", "", "[{}]"), (2, "", "", None), (3, "b", "format_error", "[]"), (4, "c", "", "[]")]
    df = spark.createDataFrame([(steps, [0, 1, 1, 0, 1])], "steps array<struct<step_idx:bigint,response:string,exit_reason:string,tool_calls:string>>, mask array<int>")
    got = df.select(rollout.spanned_traces(F.col("steps"), F.col("mask")).alias("t")).first().t
    assert [(s.step_idx, s.response_start, s.response_end, s.parse_error is not None) for s in got] == [(1, 1, 3, False), (3, 4, 5, True)]


def test_credit_edges(spark):
    """Spans that overlap compound; spans beyond the row are cut; a row without a masked token stays."""
    rows = spark.createDataFrame([(1, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0], [1, 1, 0]), (2, [1.0], [1.0], [0])], "record_index int, advantages array<double>, returns array<double>, response_mask array<int>")
    spans = spark.createDataFrame([(1, 0, 0, -5, 2, 0.0, True), (1, 1, 0, 1, 99, 0.0, True), (1, 2, 1, 2, 3, 0.0, True), (1, 3, 2, 0, 1, None, True), (2, 0, 0, None, None, 0.0, True)], "record_index int, trace_idx int, block_index int, response_start int, response_end int, distance double, is_read boolean")
    none = spark.createDataFrame([], "record_index int, distance double")
    out = {r.record_index: r for r in credit.reshape(rows, spans, none).collect()}
    assert (out[1].advantages, out[1].n_reshaped, out[2].advantages, out[2].n_reshaped) == ([3.0, 9.0, 1.0], 2, [1.0], 0)
    blocks = credit.block_factors(rows, spans).collect()
    assert [(b.record_index, b.n_blocks, b.n_wasted, [p.factor for p in b.parts]) for b in blocks] == [(1, 3, 2, [3.0])]
    assert tuple(credit.trainer_metrics(rows.limit(0).select("*", F.lit(0).alias("n_reshaped"), F.lit(0.0).alias("multiplier_sum"))).first()) == (0, 0, 0.0, 0.0)


def test_analysis_and_maps(spark, tmp_path):
    from trajspark import catalog_records

    orders = spark.range(40).withColumnRenamed("id", "o_orderkey")
    details = catalog_records._details(type("T", (), {"orders": orders}))
    out = rollout.write_analysis(details, str(tmp_path / "a"), config={"near": 0.5})
    assert out["summary"]["n_records"] == 40 and json.loads((next((tmp_path / "a/summary").glob("*.txt"))).read_text())["config"] == {"near": 0.5}
    assert spark.read.json(str(tmp_path / "a/details")).count() == 40
    assert summary.summarize(details.where("false")).first().n_records == 0 and summary.trends(details.where("false")).count() == 0
    maps = spark.createDataFrame([("a", "standard", "standard", 1), ("b", "precompute_failed", "exception", 1)], "instance_id string, case_type string, reason_code string, v int")
    rollout.write_maps(maps.withColumn("case_type", F.lit("standard")).withColumn("reason_code", F.lit("standard")), str(tmp_path / "m"))
    rollout.write_maps(maps.withColumn("v", F.lit(2)), str(tmp_path / "m"))
    assert [(r.instance_id, r.v) for r in spark.read.json(str(tmp_path / "m")).collect()] == [("a", 2)]


def test_texts(spark):
    df = spark.createDataFrame([('{"api_key": "s\\"x", "n": 1, "nested": {"Token": 5}}', "90", " 2H ", "")], "j string, a string, b string, c string")
    r = df.select(text.redacted(F.col("j")).alias("j"), *[text.duration_seconds(F.col(x)).alias(x) for x in "abc"]).first()
    assert (json.loads(r.j), r.a, r.b, r.c) == ({"api_key": "<redacted>", "n": 1, "nested": {"Token": "<redacted>"}}, 90.0, 7200.0, None)
    t = spark.createDataFrame([('{"prompt": [{"role": "u"}, 3], "tools_kwargs": {"reward": {"metadata": {"instance_id": "m__1"}}}}',), ('{"prompt": []}',), (None,)], "t string")
    assert [(r.p, r.i) for r in t.select(F.size(tasks.prompt(F.col("t"))).alias("p"), tasks.row_instance_id(F.col("t")).alias("i")).collect()] == [(1, "m__1"), (None, None), (None, None)]


def test_poll_and_stream(spark, tmp_path):
    waits, calls = [], []
    assert watch.poll(lambda: calls.append(1) or len(calls) == 3, interval=0.1, sleep=waits.append) == 3 and waits == [1.0, 1.0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"step": 1, "v": 2}\n{"step": 2, "v": 3}\n')
    for name, score in (("good", lambda rows: rows), ("bad", lambda rows: rows.select("missing"))):
        stream = spark.readStream.schema("step int, v int").json(str(tmp_path / "in"))
        q = watch.score_steps(stream, score, str(tmp_path / name), checkpoint=str(tmp_path / f"{name}-cp"))
        q.processAllAvailable()
        q.stop()
    assert spark.read.json(str(tmp_path / "good/details")).count() == 2
    assert [(r.metric, r.value) for r in spark.read.json(str(tmp_path / "bad/errors")).collect()] == [("val/error", 1.0)]


def test_large_graphs_go_by_rounds(spark):
    """Both ways give the same nodes: in a group of its own, and by rounds over distributed tables."""
    import random

    from trajspark.operators import graphs

    rng = random.Random(4)
    rows = [(g, rng.randrange(12), rng.randrange(12)) for g in range(6) for _ in range(14)]
    edges = spark.createDataFrame(rows, "instance_id int, caller long, callee long")
    starts = spark.createDataFrame([(g, 3) for g in range(7)], "instance_id int, node_key long")
    nodes = spark.createDataFrame([(g, k) for g in range(7) for k in range(12)], "instance_id int, node_key long")
    for forward in (True, False):
        small, large = ({tuple(r) for r in graphs.reachable(edges, starts, forward=forward, limit=n).collect()} for n in (1000, 12))
        assert small == large and (6, 3) in small
    small, large = ({tuple(r) for r in graphs.terminal_nodes(nodes, edges, limit=n).collect()} for n in (1000, 12))
    assert small == large and {(6, k) for k in range(12)} <= small
