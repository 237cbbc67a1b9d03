"""MinHash near-duplicates against brute force over full sets of shingles."""

import collections
import random

import pytest

from trajspark.llm import minhash_dedup
from trajspark.llm.minhash_dedup import shingle_set

SF = "/root/testdata/sf0.001"


def brute(rows, percent=80):
    """(id, set size, component, kept) of each row: every pair of rows compared on sets of strings."""
    sets = [shingle_set(t or "", 4) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    for k, i in enumerate(order):
        for j in order[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                low, high = sorted((a, b), key=order.index)
                up[high] = low
    return [(rows[i][0], len(sets[i]), rows[find(i)][0], rows[i][0] == rows[find(i)][0]) for i in range(len(rows))]


def check(spark, rows, **more):
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute(rows))


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def family(seed, n, words=60, edits=3):
    """Copies of one text with a few words changed in each: some pairs reach the threshold and others, tied by a third, don't."""
    rnd = random.Random(seed)
    base, out = [f"w{rnd.randrange(500)}" for _ in range(words)], []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            own[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("pivots", [0, 1, 3])
def test_families(spark, monkeypatch, pivots):
    """The same components whichever step compares a bucket: its first members, or blocks."""
    monkeypatch.setattr(minhash_dedup, "WORTH", 0)
    texts = [t for seed in range(6) for t in family(seed, 25)]
    random.Random(1).shuffle(texts)
    check(spark, list(enumerate(texts)), pivots=pivots)


def test_crowds(spark, monkeypatch):
    """Small limits: crowded keys joined on the map side, a frequent member dealt out."""
    monkeypatch.setattr("trajspark.llm.common.CROWD", 3)
    monkeypatch.setattr(minhash_dedup, "PARTNERS", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "WORTH", 2)
    texts = family(3, 60) + ["same text of five words"] * 40
    check(spark, list(enumerate(texts)), pivots=1)


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (5, "A B  C"), (6, "a b"), (None, "no id " * 9), (None, "no id " * 9), (7, " ".join(f"w{i % 997}x{i}" for i in range(70_000))), (8, " ".join(f"w{i % 997}x{i}" for i in range(69_000))), (9, "same " * 60), (10, "same " * 4)]


def test_awkward(spark):
    check(spark, AWKWARD)


def test_unique_awkward_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, (_, t) in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("rid", "n", "rep", "root", "key", "size", "sketch", "kept")})
    assert collections.Counter(map(tuple, minhash_dedup.near_duplicates(df).collect())) == collections.Counter(brute(rows))
    assert minhash_dedup.near_duplicates(df.where("false")).collect() == []


def test_sketches_fill_and_estimate():
    import numpy as np

    rnd = np.random.default_rng(5)
    for size in (1, 3, 40, 2000):
        names = rnd.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
        assert (minhash_dedup.sketches(names, np.array([0, size])) != minhash_dedup._EMPTY).all()
    agree = []
    for _ in range(40):
        x = rnd.integers(0, 2**63, 120, dtype=np.int64).astype(np.uint64)
        a, b = (minhash_dedup.sketches(v, np.array([0, len(v)])) for v in (x[:108], x[12:]))  # 96 of 120
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02 and np.std(agree) < 0.05
