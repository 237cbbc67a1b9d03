"""Leaks near the least similarity, against brute force."""

import collections
import random

from trajspark.llm import decontamination


def similarity(a, b):
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (a, b)]
    return sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())


def edited(rng, item, least, most):
    """A copy with some words exchanged for new ones, of a similarity in the given range."""
    while True:
        copy = list(item)
        for k in rng.sample(range(len(item)), rng.randint(1, max(2, len(item) // 30))):
            copy[k] = f"new{rng.randrange(10**6)}"
        if least <= similarity(item, copy) < most:
            return copy


def test_random_edits(spark):
    rng = random.Random(5)
    items = [[f"w{rng.randrange(500)}" for _ in range(n)] for n in (40, 64, 90) for _ in range(20)]
    items += [[f"r{i}"] * rng.randint(14, 20) + [f"v{i}x{k}" for k in range(rng.randint(20, 30))] + [f"q{i}"] * rng.randint(14, 20) for i in range(30)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for k in range(10):
            try_low = k % 5 == 4
            copy = edited(rng, item, 0.6 if try_low else 0.8, 0.8 if try_low else 0.86)
            docs.append((100 * i + k, " ".join(copy)))
            if not try_low:
                want.add((100 * i + k, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == want, (len(want - found), len(found - want), len(want))


def test_windows_of_another_items_size(spark):
    """An item is leaked by a window of its own size: what else is in the benchmark changes nothing."""
    a = [f"a{k}" for k in range(40)]
    rows = [(1, "x y z " * 30 + " ".join(a) + " u v w" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, " ".join(a)), (2, " ".join([*a, *[f"b{k}" for k in range(6)]]))]
    found = lambda own: {(r.item_id, r.n_words, round(r.similarity, 3)) for r in decontamination.leaks(docs, spark.createDataFrame(own, "item_id long, text string")).collect()}
    assert found(items) == found(items[:1]) | found(items[1:]) == {(1, 40, 1.0)}
