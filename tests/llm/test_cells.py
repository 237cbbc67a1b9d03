"""Cells of the near-dedup grid that are too full to be compared in one piece."""

import random

import numpy as np
import pytest

from trajspark.llm import simhash_dedup


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def flipped(rng: random.Random, x: int, n: int) -> int:
    for bit in rng.sample(range(64), n):
        x ^= 1 << bit
    return x


def brute_force(fps: list[int]) -> dict[int, int]:
    """The least linked fingerprint of each."""
    bits, group = np.array(fps, np.int64).view(np.uint64), np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 4)
        group[np.isin(group, group[near])] = group[near].min()
    least = {int(g): min(f for f, h in zip(fps, group, strict=True) if h == g) for g in np.unique(group)}
    return {f: least[int(g)] for f, g in zip(fps, group, strict=True)}


@pytest.fixture(scope="module")
def crowded():
    rng = random.Random(5)
    fps = {signed(rng.getrandbits(64)) for _ in range(400)}
    centre, far = rng.getrandbits(64), rng.getrandbits(64)
    fps |= {signed(flipped(rng, centre, rng.randint(0, 3))) for _ in range(300)}
    fps |= {signed(flipped(rng, far, rng.randint(3, 9))) for _ in range(300)}
    walk = rng.getrandbits(64)
    for _ in range(200):
        walk = flipped(rng, walk, 4)
        fps.add(signed(walk))
    return sorted(fps)


@pytest.mark.parametrize("limit", [2, 40, simhash_dedup.CELL])
def test_limit_changes_no_component(spark, crowded, limit):
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in crowded], "fp long"), limit=limit)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links.collect())
    roots = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    assert {f: roots.get(f, f) for f in crowded} == brute_force(crowded)


def test_crowds_are_named_like_others(spark, monkeypatch):
    texts = [(i, "the same few words stand here" if i % 3 else f"text {i} " + "one of many words " * (i % 7)) for i in range(5, 60)]
    docs = spark.createDataFrame(texts + [(4, None), (90, "")], "doc_id long, text string")
    want = sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash_dedup, "CROWD", 0)
    assert sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect())) == want
