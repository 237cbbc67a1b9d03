"""Lines looked up in nested and overlapping ranges, against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import overlap


def tables(spark, points, ranges):
    return spark.createDataFrame(points, "id long, file_path string, line_no int, qualified_name string"), spark.createDataFrame(ranges, "file_path string, start_line int, end_line int, qualified_name string, place long")


def some(seed, files=2, n=120, lines=300):
    rnd = random.Random(seed)
    at = lambda: rnd.randrange(-3, lines)
    ranges = [(f"f{rnd.randrange(files)}", s, s + rnd.choice((0, 1, 5, 40, 1000)), f"q{rnd.randrange(9)}", i) for i, s in enumerate(at() for _ in range(n))]
    return [(i, f"f{rnd.randrange(files + 1)}", at(), f"q{rnd.randrange(9)}") for i in range(n)], ranges


def held(point, ranges):
    return [r for r in ranges if r[0] == point[1] is not None and r[1] is not None and r[2] is not None and point[2] is not None and r[1] <= point[2] <= r[2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges(spark, seed):
    points, ranges = some(seed)
    points += [(900, "f0", None, "q1"), (901, None, 3, "q1"), (902, "f0", 2**31 - 1, None), (0, *points[0][1:])]
    ranges += [("f0", 9, 2, "q1", 900), ("f0", None, 4, "q1", 901), (None, 1, 9, "q1", 902), ("f0", 0, 2**31 - 1, "whole", 903)]
    p, r = tables(spark, points, ranges)
    assert sorted(x.id for x in overlap.in_some_range(p, r).collect()) == sorted(x[0] for x in points if held(x, ranges))
    want = sorted((x[0], min((h[4] for h in held(x, ranges)), default=-1)) for x in points)
    assert sorted((x.id, -1 if x.first is None else x.first.place) for x in overlap.first_range(p, r, "place").collect()) == want
    rank = lambda x, h: (x[3] is not None and h[3] != x[3], h[2] - h[1], -h[1], h[3])
    inner = {x[0]: min(held(x, ranges), key=lambda h: rank(x, h))[3] for x in points if held(x, ranges)}  # noqa: B023
    assert {x.id: x.callable for x in overlap.innermost(p, r, ["id"]).collect()} == inner


def test_empty(spark):
    p, r = tables(spark, [(1, "f", 1, "q")], [("f", 1, 1, "q", 1)])
    assert overlap.in_some_range(p.where("false"), r).collect() == [] and overlap.in_some_range(p, r.where("false")).collect() == []
    assert overlap.first_range(p, r.where("false"), "place").first().first is None


def test_each_pair_meets_once_and_a_hot_file_is_many_keys(spark):
    points = spark.range(20_000).select(F.lit("hot").alias("file_path"), F.col("id").cast("int").alias("line_no"))
    ranges = spark.range(20_000).select(F.lit("hot").alias("file_path"), F.col("id").cast("int").alias("start_line"), (F.col("id") + F.col("id") % 7).cast("int").alias("end_line"))
    met = overlap.stab(points, ranges, ["file_path"])
    assert met.count() == sum(min(i + i % 7, 19_999) - i + 1 for i in range(20_000))
    sizes = ranges.select(F.explode(overlap._blocks(F.col("start_line"), F.col("end_line"))).alias("b")).groupBy("b").count()
    assert sizes.agg(F.max("count")).first()[0] < 200
