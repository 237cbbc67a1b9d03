"""Which content-named places of a corpus occur more than once: the two phases that both substring operators share.

Phase one names places of each text by a hash and finds, over the whole corpus, the names that occur twice or more; rows
with one name meet by a shuffle and are compared with their neighbours in a sorted stream, so no group is ever held.
Phase two brings each text together with its own shared places. To keep a frequent name from making a hot task, a batch
sends one row for each name that it has several times; its other rows are known to be shared and travel under a random key.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .words import mix, signed

#: Characters of the texts that are worked on at once in Python; one longer text is worked on by itself.
CHARS = 500_000
#: names, places and texts' numbers of the places that a batch of texts has
Namer = Callable[[list[str | None]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_size(texts: list[str | None], limit: int = CHARS) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > limit:
            yield slice(start, i)
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def firsts_and_others(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: whether a row is the first of several with its keys, and whether it is a later one."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    first, other = np.zeros(len(order), bool), np.zeros(len(order), bool)
    other[order[1:][same]] = True
    first[order[:-1][same]] = True
    return first & ~other, other


def scattered(rids: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mix(rids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64))


def _named(namer: Namer, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for part in by_size(texts):
            names, places, which = namer(texts[part])
            own = rids[part][which] if len(which) else np.empty(0, np.int64)
            first, other = firsts_and_others(names)
            key = np.where(other, scattered(own, places), names)
            yield pa.RecordBatch.from_arrays([signed(key), pa.array(own, pa.int64()), pa.array(places.astype(np.int32)), pa.array(first | other)], names=["key", "rid", "place", "known"])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those that are known, or have the key of the row before or behind."""
    kept = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        # The last row waits for the next batch; the one before it goes along, already given, to be compared with.
        rows = now if kept is None else [np.concatenate(x) for x in zip(kept[0], now, strict=True)]
        given = 0 if kept is None else kept[1]
        same = rows[0][1:] == rows[0][:-1]
        hit = rows[3] | np.append(same, False) | np.insert(same, 0, False)
        out = np.flatnonzero(hit[given:-1]) + given
        yield pa.RecordBatch.from_arrays([pa.array(rows[1][out]), pa.array(rows[2][out])], names=["rid", "place"])
        kept = [r[-2:] for r in rows], min(len(rows[0]) - 1, 1)
    if kept is not None:
        rows = kept[0]
        if rows[3][-1] or (len(rows[0]) > 1 and rows[0][-1] == rows[0][-2]):
            yield pa.RecordBatch.from_arrays([pa.array(rows[1][-1:]), pa.array(rows[2][-1:])], names=["rid", "place"])


def release_shuffles(spark) -> None:
    """Have Python and the JVM notice that earlier jobs' shuffle files are no longer needed, so that Spark deletes them now."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def with_shared_places(docs: DataFrame, namer: Namer) -> DataFrame:
    """``docs`` (_rid, _text, ...) with ``_places``: those of the places named in its text whose name occurs twice or more."""
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select("_rid", "_text").mapInArrow(lambda b: _named(namer, b), "key long, rid long, place int, known boolean")
    found = named.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "rid long, place int")
    # What two batches have in common is the least that a lost executor costs from here on.
    lists = materialise(found.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list("place").alias("_places")), "places")
    release_shuffles(spark)
    return docs.join(lists, "_rid", "left")
