"""Ids of tasks and the cut of long traces."""

from pyspark.sql import functions as F

from trajspark.functions import tasks


def test_task_id(spark):
    sha = "2d9617bd0cb1f0ba61771258410ab8fae8e7e24d"
    rows = [("a__a-1", None, None, None), (sha, "orange", sha, None), (None, None, sha, "own/orange_final:tag"), (None, None, sha, "plain"), (sha, None, None, None), (None, None, None, None), ("", "", "", "own/:x")]
    df = spark.createDataFrame(rows, "i string, r string, c string, d string")
    got = [r[0] for r in df.select(tasks.task_id(F.col("i"), F.col("r"), F.col("c"), F.col("d"))).collect()]
    assert got == ["a__a-1", "orange__2d9617bd", "orange__2d9617bd", "2d9617bd0cb1", sha, "unknown", "unknown"]


def test_kept_frames(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2, 3],)], "f array<int>")
    assert [r[0] for r in df.select(tasks.kept_frames(F.col("f"), 3)).collect()] == [[1, 4, 5], [1, 2, 3]]
