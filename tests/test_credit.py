"""The sweep over spans against a product for each token."""

import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import credit

PARTS = "array<struct<spans:array<struct<start:int,end:int>>,factor:double>>"


def plain(values, mask, parts):
    """Factors multiplied in the order of the parts, then onto the value: the same operations on the same numbers."""
    out = []
    for i, x in enumerate(values):
        f = 1.0
        for spans, factor in parts:
            if any(a <= i < b for a, b in spans):
                f = f * factor
        out.append(x * f if i < len(mask) and mask[i] else x)
    return out


def rows(seed, n):
    rnd = random.Random(seed)
    for k in range(n):
        size = rnd.choice((1, 2, 30, 200))
        span = lambda: tuple(sorted((rnd.randrange(size + 1), rnd.randrange(size + 1))))  # noqa: B023, E731
        parts = [([s for s in (span() for _ in range(rnd.randrange(1, 4))) if s[0] < s[1]], 3.0 ** rnd.uniform(-1, 1)) for _ in range(rnd.randrange(6))]
        yield k, [rnd.uniform(-1, 1) for _ in range(size)], [rnd.randrange(2) for _ in range(size + rnd.choice((-1, 0, 0, 2)))], parts


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_is_exact(spark, seed):
    data = list(rows(seed, 60)) + [(900, [], [], [([(0, 1)], 3.0)]), (901, [1.0], [1], None)]
    df = spark.createDataFrame([(k, v, v, m) for k, v, m, _ in data], "record_index long, advantages array<double>, returns array<double>, response_mask array<int>")
    parts = spark.createDataFrame([(k, p) for k, _, _, p in data if p is not None], f"record_index long, parts {PARTS}")
    got = {r.record_index: r for r in credit.apply(df, parts).collect()}
    for k, values, mask, p in data:
        want = plain(values, mask, p or [])
        assert list(got[k].advantages) == want and list(got[k].returns) == want and got[k].n_reshaped == len(p or [])


def test_covered(spark):
    data = [(k, m, [s for spans, _ in p for s in spans]) for k, _, m, p in rows(3, 40)]
    df = spark.createDataFrame(data, "k long, mask array<int>, spans array<struct<start:int,end:int>>")
    got = {r.k: r.n for r in df.select("k", credit._covered(F.col("mask"), F.col("spans")).alias("n")).collect()}
    assert got == {k: sum(1 for i, m in enumerate(mask) if m and any(a <= i < b for a, b in spans)) for k, mask, spans in data}


def test_long_rows(spark):
    """Rows of 64 Ki tokens and 200 steps: a product for each token of each step would be some 10**8 steps of an interpreter."""
    n, steps = 65_536, 200
    rows_ = spark.range(8).select(F.col("id").alias("record_index"), F.lit("i").alias("instance_id"), *[F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("double")).alias(c) for c in ("advantages", "returns")], F.array_repeat(F.lit(1), n).alias("response_mask"))
    spans = spark.range(8).select(F.col("id").alias("record_index"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("trace_idx")).select("*", (F.col("trace_idx") * 300).alias("response_start"), (F.col("trace_idx") * 300 + 500).alias("response_end"), F.lit(0.5).alias("distance"), F.lit(True).alias("is_read"))
    out = credit.reshape(rows_, spans, spans.select("record_index", "distance").limit(0)).first()
    f = 3.0**0.5
    assert out.advantages[0] == 1 * f and out.advantages[310] == 311 * (f * f) and out.advantages[65_000] == 65_001 and out.n_reshaped == steps
