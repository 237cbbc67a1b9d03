"""Values of single operators."""

import pytest
from pyspark.sql import functions as F

from trajspark.functions import callables, reads, text
from trajspark.operators import graphs, overlap, sequences, upsert
from trajspark.sources import records


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "command, want",
    [
        ("cat /testbed/foo.py", [("foo.py", 1, 999999)]),
        ("head -20 /testbed/bar.py", [("bar.py", 1, 20)]),
        ("head /testbed/bar.py", [("bar.py", 1, 50)]),
        ("tail -5 /testbed/baz.py", [("baz.py", 1, 999999)]),
        ("sed -n '10,20p' /testbed/qux.py", [("qux.py", 10, 20)]),
        ("grep -n needle /testbed/qux.py", [("qux.py", 1, 999999)]),
        ("echo nothing", []),
    ],
)
def test_bash_reads(spark, command, want):
    assert [tuple(r) for r in one(spark, reads.reads_in_text(F.col("c")), c=command)] == want


def test_views(spark):
    call = '{"name": "str_replace_editor", "arguments": {"command": "view", "path": "/testbed/bar.py", "view_range": [5, -1]}}'
    assert [tuple(r) for r in one(spark, reads.reads_in_text(F.col("c"), "view_only"), c=call)] == [("bar.py", 5, 999999)]
    xml = '<function=file_editor><parameter name="command">view</parameter><parameter name="path">./a.py</parameter><parameter name="view_range">[2, 9]</parameter>'
    assert [tuple(r) for r in one(spark, reads.reads_in_text(F.col("c"), "view_only"), c=xml)] == [("a.py", 2, 9)]
    calls = F.array(F.struct(F.lit("str_replace_editor").alias("name"), F.lit('{"command":"view","path":"/testbed/bar.py","view_range":[5,9]}').alias("arguments")), F.struct(F.lit("execute_bash").alias("name"), F.lit('{"command":"cat x.py"}').alias("arguments")))
    assert [tuple(r) for r in one(spark, reads.reads_in_tool_calls(calls), c="")] == [("bar.py", 5, 9), ("x.py", 1, 999999)]
    assert one(spark, reads.reads_in_text(F.col("c")), c=None) == []


def test_scalars(spark):
    assert one(spark, text.normalize_path(F.col("c")), c=" ../a ") == "../a" and one(spark, text.normalize_path(F.col("c")), c="./../a") == "a"
    assert [one(spark, text.is_test_file(F.col("c")), c=p) for p in ("a/tests/b.py", "a/test_b.py", "src/b.py", "conftest.py")] == [True, True, False, True]
    assert one(spark, text.error_kind(F.col("c")), c="WebSocket closed: 403") == "arl_shell_forbidden"
    assert one(spark, text.error_kind(F.col("c")), c=None) is None
    assert one(spark, text.instance_candidates(F.col("c")), c="org__name__0123456789ab") == ["org__name__0123456789ab", "org__name__01234567"]
    assert one(spark, text.patched_files(F.col("c")), c="--- a/x/y.py\n+++ b/x/y.py\n--- /dev/null\n+++ b/n.py\n") == ["n.py", "x/y.py"]
    assert one(spark, text.status_lines(F.col("c")), c="t.py::a PASSED\nt.py::a FAILED\nERROR t.py::b") == {"t.py::a": "FAILED", "t.py::b": "ERROR"}
    assert [one(spark, text.duration_seconds(F.col("c")), c=c) for c in ("15m", "2h", "30s", "x")] == [900.0, 7200.0, 30.0, None]


def test_callables(spark):
    source = "class A:\n    @p\n    def f(self):\n        def g():\n            pass\n        return g\n"
    assert [(c[1], c[3], c[4]) for c in callables.callables(source, "a.py")] == [("A.f", 2, 6), ("A.f.<locals>.g", 4, 5)]
    assert callables.callables("def (", "a.py") == []
    assert callables.extract_callables(spark.createDataFrame([("a.py", source), ("b.py", None)], "file_path string, content string")).count() == 2


def test_overlap(spark):
    r = spark.createDataFrame([(1, "i", 0, "a.py", 1, 20), (2, "i", 0, "b.py", 1, 2)], "record_index long, instance_id string, trace_idx int, file_path string, start_line int, end_line int")
    n = spark.createDataFrame([("i", "x", "a.py", 1, 8, 0.0, False), ("i", "y", "a.py", 20, 30, 0.25, True)], "instance_id string, node_key string, file_path string, start_line int, end_line int, normalized_distance double, rewardable boolean")
    got = overlap.min_distance(r, n, spark.createDataFrame([(1,), (2,), (3,)], "record_index long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 0.25), (2, 1, 0, -1.0), (3, 0, 0, -1.0)]
    maps = spark.createDataFrame([("a__01234567", 5)], "map_id string, v int")
    ids = spark.createDataFrame([(1, "a__0123456789"), (2, "b")], "record_index long, id string").withColumn("c", text.instance_candidates(F.col("id")))
    assert {r.record_index: r.v for r in overlap.with_alias(ids, maps, "c").collect()} == {1: 5, 2: None}


def test_blocks(spark):
    rows = [(1, 0, "read", "a"), (1, 1, "read", "a"), (1, 2, "read", None), (1, 3, "read", None), (1, 4, "edit", "b")]
    steps = spark.createDataFrame(rows, "record_index long, trace_idx int, family string, target string")
    assert [r.block_index for r in sequences.purpose_blocks(steps).orderBy("trace_idx").collect()] == [0, 0, 1, 1, 2]


def test_reshape(spark):
    row = spark.createDataFrame([([1.0] * 4, [1, 1, 1, 1])], "a array<double>, m array<int>")
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit(3.0).alias("multiplier")))
    assert row.select(sequences.reshape_advantages(F.col("a"), F.col("m"), spans)).first()[0] == [1, 1, 3, 3]
    assert row.select(sequences.masked_sign(F.col("a"), F.col("m"))).first()[0] == 1
    spans = sequences.mask_spans(spark.createDataFrame([(1, [1, 1, 0, 0, 1, 1, 1])], "k int, response_mask array<int>"), "k")
    assert sorted((r.start, r.end) for r in spans.collect()) == [(0, 2), (4, 7)]


def test_graphs(spark):
    e = spark.createDataFrame([("i", a, b) for a, b in ["ab", "bc", "cb", "xa"]], "instance_id string, caller string, callee string")
    start = spark.createDataFrame([("i", "a")], "instance_id string, node_key string")
    assert {r.node_key for r in graphs.reachable(e, start).collect()} == set("abc")
    assert {r.node_key for r in graphs.reachable(e, start, forward=False).collect()} == set("ax")
    nodes = spark.createDataFrame([("i", k) for k in "abcx"], "instance_id string, node_key string")
    assert {r.node_key for r in graphs.terminal_nodes(nodes, e).collect()} == set("bc")
    t = spark.createDataFrame([("i", [1, 2, 3]), ("i", [1, 3]), ("i", [3, 1]), ("i", [1, 3])], "instance_id string, frames array<int>")
    assert sorted(r.frames for r in graphs.maximal_traces(t).collect()) == [[1, 2, 3], [3, 1]]
    frames = spark.createDataFrame([("i", 0, k, n, n == "t") for k, n in enumerate(["test", "mid", "t"])], "instance_id string, trace_idx int, frame_idx int, node_key string, is_patched boolean")
    assert {(r.caller, r.callee) for r in graphs.call_edges(frames).collect()} == {("test", "mid"), ("mid", "t")}
    roots = frames.where("is_patched")
    assert {r.node_key: r.hop for r in graphs.hop_distances(frames, roots).collect()} == {"test": 2, "mid": 1, "t": 0}


def test_upsert(spark):
    cols = "k int, v string, created string"
    old, new = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], cols), spark.createDataFrame([(2, None, "t2"), (3, "c", "t2")], cols)
    once = upsert.upsert(old, new, ["k"], keep_old=["created"])
    want = [(1, "a", "t1"), (2, None, "t1"), (3, "c", "t2")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upsert.upsert(once, new, ["k"], keep_old=["created"]).collect())) == want
    cells = spark.createDataFrame([(1, 0, "pending", None)], "cell_id int, attempts int, status string, error string")
    runs = spark.createDataFrame([(1, 1, "boom"), (1, 2, None)], "cell_id int, ingest_order int, error string")
    assert tuple(upsert.add_attempts(cells, runs).first()) == (1, 2, "done", None)


def test_scan(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instance_id": "x__1", "extra_info": {"trainer_step": "7.9"}}\n\n{"data": [{"instance_id": "y"}, {"extra_info": {"instance_id": "z"}}]}\n')
    (tmp_path / "b.json").write_text('[{"instance_id": "w", "data_source": "d"}, 3]')
    got = records.scan_records(spark, str(tmp_path)).select(records.instance_id(F.col("raw")).alias("i"), records.data_source(F.col("raw")).alias("d"), records.run_step(F.col("raw")).alias("s"))
    assert sorted(map(tuple, got.collect())) == [("w", "d", None), ("x__1", "unknown", 7), ("y", "unknown", None), ("z", "unknown", None)]
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="malformed JSONL"):
        records.scan_records(spark, str(tmp_path)).collect()
    assert records.scan_records(spark, str(tmp_path), strict=False).count() == 4


def test_watch(spark, tmp_path):
    from trajspark.streaming.watch import watch_records

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n')
    seen = []
    watch_records(spark, str(tmp_path / "in"), "id string", lambda df, n: seen.append(df.count()), checkpoint=str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 2
