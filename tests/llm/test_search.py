"""Ranked lexical search against a plain scan of every document for every item."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.llm import lexical_search

TERM = re.compile(lexical_search.TERM)


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    number, total = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counted:
            m = 100 - 90 + 90 * n * number // total
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(item, rank, d, s) for rank, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def check(spark, docs, items, **more):
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute(docs, items, more.get("k", 10)))


def corpus(seed, n, vocabulary=300):
    """Texts whose words have very unlike frequencies, with ties among short ones."""
    rnd = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rnd.random() ** 3)}"
    return [" ".join(word() for _ in range(rnd.choice((1, 3, 20, 80)))) for _ in range(n)]


@pytest.mark.parametrize("k, block", [(10, 200_000), (3, 40), (1, 120)])
def test_random(spark, k, block):
    check(spark, list(enumerate(corpus(1, 700))), [(f"q{i}", t) for i, t in enumerate(corpus(2, 25))], k=k, block=block)


def test_pieces(spark, monkeypatch):
    """Few postings at a time, so thresholds rise between the pieces of a task."""
    monkeypatch.setattr(lexical_search, "POSTINGS", 50)
    check(spark, list(enumerate(corpus(3, 300))), [(f"q{i}", t) for i, t in enumerate(corpus(4, 10))], k=4)


AWKWARD = [(1, None), (2, ""), (3, "-- !"), (4, "A b_c naïve 日本語"), (4, "a B c naïve 日本語"), (None, "a b c d"), (None, "a b c d"), (5, "word " * 70_000 + "rare"), (6, "a"), (7, "a"), (8, "x\x00y\x7fz")]


def test_awkward(spark):
    items = [("p", "a b"), ("p", "a b"), (None, "RARE, word; ïve naïve"), ("e", ""), ("n", None), ("u", "unknown"), ("y", "Y")]
    check(spark, AWKWARD, items)
    check(spark, AWKWARD, items, k=2, block=2)


def test_clashing_columns_and_empty_tables(spark):
    docs = list(enumerate(corpus(5, 40)))
    names = ("doc", "n", "term", "item", "score", "rank", "_item", "_id", "_terms", "df")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in names})
    items = [(f"q{i}", t) for i, t in enumerate(corpus(6, 5))]
    asked = spark.createDataFrame(items, "item_id string, text string").withColumns({c: F.lit(7) for c in names})
    assert sorted(map(tuple, lexical_search.search(df, asked).collect())) == sorted(brute(docs, items))
    assert lexical_search.search(df.where("false"), asked).collect() == []
    assert lexical_search.search(df, asked.where("false")).collect() == []


def test_pruning_drops_only_what_cannot_win():
    """Of the terms of an item, those in order of their greatest share whose sum stays below the seed are pruned."""
    items = lexical_search.Items.of([(0, [b"a", b"b", b"c"]), (1, [b"c"])])
    p = lexical_search.plan(items, np.array([10, 20, 30]), kth=np.array([0, 0, 5]), most=np.array([4, 5, 9]))
    assert p.threshold.tolist() == [150, 150] and p.rest.tolist() == [140, 0]
    assert dict(zip(zip(items.item.tolist(), np.repeat([0, 1, 2], np.diff(items.start)).tolist(), strict=True), p.needed.tolist(), strict=True)) == {(0, 0): False, (0, 1): False, (0, 2): True, (1, 2): True}
