"""Maximal traces against every pair of traces."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trajspark.operators import graphs


def brute(rows):
    def inside(a, b):
        rest = iter(b)
        return all(x in rest for x in a)

    own = {(i, tuple(f)) for i, f in rows}
    return {(i, f) for i, f in own if not any(i == j and len(f) < len(g) and inside(f, g) for j, g in own)}


@pytest.mark.parametrize("alphabet", [3, 30])
def test_random(spark, alphabet):
    rnd = random.Random(alphabet)
    rows = [(f"i{rnd.randrange(3)}", [rnd.randrange(alphabet) for _ in range(rnd.randrange(0, 9))] + [99] * (rnd.random() < 0.8)) for _ in range(250)]
    rows += [(i, [x for x in f if rnd.random() < 0.7]) for i, f in rows[:80]]
    got = graphs.maximal_traces(spark.createDataFrame(rows, "instance_id string, frames array<int>")).collect()
    assert len(got) == len(brute(rows)) and {(r.instance_id, tuple(r.frames)) for r in got} == brute(rows)


def test_one_last_frame(spark):
    """10,000 traces that end in one patched function: 10**8 pairs share it, few share a rare frame."""
    frame = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3000))
    whole = spark.range(9_000).select(F.lit("i").alias("instance_id"), F.array(*[frame(k) for k in range(12)], F.lit(-1).cast("long")).alias("frames"))
    parts = whole.limit(1000).select("instance_id", F.concat(F.slice("frames", 3, 6), F.array(F.lit(-1).cast("long"))).alias("frames"))
    start = time.time()
    assert graphs.maximal_traces(whole.unionAll(parts)).count() == 9_000
    assert time.time() - start < 60
