"""Scans of folders with files of several kinds: order, line numbers, errors with path and line."""

import json

import pytest
from pyspark.sql import functions as F

from trajspark.sources import records


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, blank=()):
    path.write_text("".join(("\n" if i in blank else "") + json.dumps(r) + "\n" for i, r in enumerate(rows)))


def test_lines_over_many_splits(small_splits, tmp_path):
    """Files of many splits, several of them in one partition; blank lines count."""
    want = []
    for name, n in (("b.jsonl", 700), ("a.JSONL", 3), ("sub.jsonl", 150)):
        write(tmp_path / name, [{"id": f"{name}-{i}"} for i in range(n)], blank={1, 2})
        want += [(name, i + 1 + sum(i >= b for b in (1, 2)), f"{name}-{i}") for i in range(n)]
    got = records.scan_records(small_splits, str(tmp_path)).select(F.substring_index("file", "/", -1), "line", F.get_json_object("raw", "$.id")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_error_names_path_and_line(small_splits, tmp_path):
    write(tmp_path / "good.jsonl", [{"id": i} for i in range(300)])
    path = tmp_path / "bad one.jsonl"
    path.write_text("".join(json.dumps({"id": i, "pad": "x" * 30}) + "\n" for i in range(411)) + "\n{nope\n" + '{"id": 1}\n')
    with pytest.raises(Exception, match=r"bad(%20| )one\.jsonl:413: malformed JSONL: \{nope"):
        records.scan_records(small_splits, str(tmp_path)).collect()
    assert records.scan_records(small_splits, str(tmp_path), strict=False).count() == 300 + 412


def test_suffixes_and_order(spark, tmp_path):
    (tmp_path / "c").mkdir()
    spark.createDataFrame([("p1", 1), ("p2", 2)], "id string, step int").coalesce(1).write.parquet(str(tmp_path / "c/x"))
    write(tmp_path / "d.jsonl", [{"id": "l1"}, {"rollouts": [{"id": "l2"}, {"id": "l3"}]}])
    (tmp_path / "a.json").write_text(json.dumps([{"id": "j1"}, {"id": "j2"}]))
    (tmp_path / "b.txt").write_text("not a record\n")
    got = [r.id for r in records.in_order(records.scan(spark, str(tmp_path))).select(F.get_json_object("raw", "$.id").alias("id")).collect()]
    assert got == ["j1", "j2", "p1", "p2", "l1", "l2", "l3"]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/n.jsonl").write_text("\n")
    assert records.scan(spark, str(tmp_path / "e")).collect() == []
