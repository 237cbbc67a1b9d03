"""Files that rollouts and traces are written to."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from trajspark.plans import callgraph, rollout
from trajspark.sources import records


def test_sidecar(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y", "z"], ["u"]), ("b", [], None)], "instance_id string, raw_traces array<string>, f2p_traces array<string>")
    records.write_sidecar(df, str(tmp_path / "s"), 2)
    assert list((tmp_path / "s").glob("*.json.gz"))
    a, b = spark.read.json(str(tmp_path / "s")).orderBy("instance_id").collect()
    assert (a.raw_traces, tuple(a.counts.raw_traces), tuple(a.counts.f2p_traces)) == (["x", "y"], (2, 3, True), (1, 1, False))
    assert (b.raw_traces, b.f2p_traces, tuple(b.counts.f2p_traces)) == ([], [], (0, 0, False))


def test_jsonl_manifest_and_skips(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1)], "instance_id string, v int")
    records.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(line for f in (tmp_path / "j").glob("*.json") for line in f.read_text().split("\n") if line) == ['{"instance_id":"a","v":null}', '{"instance_id":"b","v":1}']
    for _ in range(2):
        records.append_manifest(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    records.write_with_skips(df, df.where("v = 1"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/full")).count() == 2 and [r.instance_id for r in spark.read.parquet(str(tmp_path / "p/filtered")).collect()] == ["a"]


def test_maps_leave_the_session_as_it_is(spark, tmp_path):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    df = spark.createDataFrame([("a", "standard", None), ("b", "direct", None)], "instance_id string, case_type string, reason_code string")
    rollout.write_maps(df, str(tmp_path / "maps"))
    rollout.write_maps(df.where("instance_id = 'a'").withColumn("reason_code", F.lit("again")), str(tmp_path / "maps"))
    assert spark.conf.get(key) == before
    assert {r.instance_id for r in spark.read.json(str(tmp_path / "maps")).collect()} >= {"b"}


def test_without_internals(spark):
    df = spark.createDataFrame([("f", 1, 2, "s")], "qualified_name string, instr_line int, start_line int, source string")
    assert callgraph.without_internals(df).columns == ["qualified_name", "start_line"]


@pytest.mark.parametrize("query", ["terminal_components_whole"])
def test_workers_get_the_package(tmp_path, query):
    """Started from another folder, with nothing on the workers' path."""
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry", {str(repo / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("rows", entry.queries()[{query!r}](spark, "/root/testdata/sf0.001").count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]
