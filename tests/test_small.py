"""Small functions against worked values."""

from pyspark.sql import functions as F

from trajspark.functions import text as fn
from trajspark.operators import graphs, upsert
from trajspark.plans import cache, casetype
from trajspark.streaming import watch


def test_texts(spark):
    df = spark.createDataFrame([("pkg/sub/mod.py",), ("pkg/__init__.py",), ("mod.py",), (None,)], "p string")
    assert [r[0] for r in df.select(fn.module_name(F.col("p"))).collect()] == ["pkg.sub.mod", "pkg", "mod", None]
    df = spark.createDataFrame([("abcdef",), ("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(fn.tail_text(F.col("t"), 3)).collect()] == ["def", "ab", None]


def test_cells(spark):
    cells = spark.createDataFrame([(1, "pending", None), (2, "pending", "t0"), (3, "done", "t0"), (4, "pending", None)], "cell_id long, status string, started_at string")
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,)], "cell_id long")
    assert sorted(map(tuple, upsert.mark_running(cells, ids, "t9").collect())) == [(1, "running", "t9"), (2, "running", "t0"), (3, "done", "t0"), (4, "pending", None)]
    row = lambda snapshot, at: spark.createDataFrame([("e", "p", "d", snapshot, at, at)], cache.TABLES["experiments"])
    out = cache.upsert_experiments(row("old", "t0"), row("new", "t9")).collect()
    assert [(r.config_snapshot, r.created_at, r.updated_at) for r in out] == [("new", "t0", "t9")]
    assert cache.upsert_experiments(row("old", "t0").limit(0), row("new", "t9")).first().created_at == "t9"


def test_static_map(spark):
    df = spark.createDataFrame([("i", "a.py", "C.m", 3, 9)], "instance_id string, file_path string, qualified_name string, start_line int, end_line int")
    r = casetype.static_map(df).first()
    assert (r.node_key, r.hop_distance, r.normalized_distance, r.rewardable, r.node_role, r.start_line) == ("a.py::C.m", 0, 0.0, True, "root_cause", 3)


def test_distances(spark):
    hops = spark.createDataFrame([("i", "a", 0, True), ("i", "b", 2, True), ("i", "h", 9, False), ("j", "x", 0, True)], "instance_id string, node_key string, hop int, rewardable boolean")
    assert {r.node_key: (r.hop_max, r.normalized_distance) for r in graphs.normalized_distances(hops).collect()} == {"a": (2, 0.0), "b": (2, 1.0), "h": (2, 1.0), "x": (1, 0.0)}


def test_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(f'{{"ts": "2024-01-01T00:{m:02}:00Z", "event_type": "e", "value": {m}, "event_id": "{m % 3}"}}\n' for m in (0, 1, 4, 6)))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, event_id string").json(str(tmp_path / "in"))
    for name, df, mode, want in (("counts", watch.windowed_counts(stream), "complete", [(1, 6.0), (3, 5.0)]), ("distinct", watch.distinct_events(stream).select("event_id"), "append", [("0",), ("1",)])):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(name)
        assert sorted(map(tuple, got.drop("window", "event_type").collect())) == want
