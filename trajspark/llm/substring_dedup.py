"""Substring dedup by recompression.

A window is ``size`` consecutive words of a document. Words of windows that also start earlier are removed. Texts are
recompressed round by round (see ``recompression``): a repeated window then holds equal symbols at equal places, but for
those whose making looked beyond its ends. Each window is represented by the symbols of the highest level that has any
inside it, looks included. Phase one finds the symbols that occur twice or more in the corpus. A window all of whose
symbols do is a candidate, as is one without any inside it (a long run of one word); no other window can have an equal.
Phase two gives each candidate its identity, 128 bits over the words' two independent names, and brings equal ones together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, row_ids
from .recompression import levels
from .shared_places import by_size, firsts_and_others, release_shuffles, scattered, with_shared_places
from .words import BASES, signed, text_of, window_hashes, word_names

SIZE, TOP = 20, 5
LEVELS = 16  # a place in phase one is LEVELS * (first word) + level


def _inside(start_low: np.ndarray, start_high: np.ndarray, n: int) -> np.ndarray:
    """For each place, how many of the intervals [start_low, start_high] hold it."""
    ok = start_high >= start_low
    return np.cumsum(np.bincount(start_low[ok], minlength=n + 1) - np.bincount(start_high[ok] + 1, minlength=n + 1)[: n + 1])[:n]


def _windows(edges: np.ndarray, size: int) -> np.ndarray:
    """Which places a window starts at."""
    n = int(edges[-1])
    starts = np.zeros(n + 1, np.int64)
    long = np.diff(edges) >= size
    starts[edges[:-1][long]] += 1
    np.subtract.at(starts, edges[1:][long] - size + 1, 1)
    return np.cumsum(starts)[:n] > 0


def represented(names: np.ndarray, edges: np.ndarray, size: int):
    """Level by level from the top: its symbols that represent a window, and the windows that they represent."""
    n = int(edges[-1])
    open_ = _windows(edges, size)
    for level, name, start, low, high in levels(names, edges, TOP):
        a, b = np.maximum(high - size + 1, 0), low
        before = np.concatenate([[0], np.cumsum(open_)])
        # A symbol at a text's edge has looked beyond it, and no window of the text holds that place.
        used = (b >= a) & (low >= 0)
        used[used] = before[b[used] + 1] > before[a[used]]
        held = (_inside(a[used], b[used], n) > 0) & open_
        yield level, name[used], start[used], a[used], b[used], held
        open_ &= ~held
        if not open_.any():
            return


def symbol_names(size: int, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, _, edges = word_names(texts)
    found = [(name + np.uint64(level), start, np.full(len(start), level)) for level, name, start, _, _, _ in represented(names, edges, size)] or [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    name, start, level = (np.concatenate(x) for x in zip(*found, strict=True))
    which = text_of(start, edges)
    return name, (start - edges[which]) * LEVELS + level, which


def candidates(names: np.ndarray, edges: np.ndarray, places: list[list[int] | None], size: int) -> np.ndarray:
    """Where windows start that may have an equal somewhere."""
    n = int(edges[-1])
    sizes = [len(p or ()) for p in places]
    flat = np.fromiter((x for p in places for x in p or ()), np.int64, sum(sizes))
    at, level_of = flat // LEVELS + np.repeat(edges[:-1], sizes), flat % LEVELS
    rest, out = _windows(edges, size), np.zeros(n, bool)
    for level, _, start, a, b, held in represented(names, edges, size):
        shared = np.isin(start, at[level_of == level])
        lone = _inside(a[~shared], b[~shared], n) > 0
        out |= held & ~lone
        rest &= ~held
    return np.flatnonzero(out | rest)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _find(size: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (h1, h2, _rid, start) for each candidate window.

    Of windows that are equal in one batch, the first one stands for all. The others are known to be later ones: they go
    under a random key, with -1 - start for their start.
    """
    for batch in batches:
        rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0])
        texts = [r[1] for r in rows]
        for part in by_size(texts):
            names, more, edges = word_names(texts[part])
            at = candidates(names, edges, [r[2] for r in rows[part]], size)
            if not len(at):
                continue
            hashes = [window_hashes(x, size, b)[at] for x, b in zip((names, more), BASES, strict=True)]
            which = text_of(at, edges)
            start, rid = at - edges[which], np.array([r[0] for r in rows[part]], np.int64)[which]
            _, later = firsts_and_others(*hashes)
            h1 = np.where(later, scattered(rid, start), hashes[0])
            yield pa.RecordBatch.from_arrays([signed(h1), signed(hashes[1]), pa.array(rid), pa.array(np.where(later, -1 - start, start).astype(np.int32))], names=["h1", "h2", "_rid", "start"])


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h1: all windows but the first of each (h1, h2). Of the last h1, the firsts so far wait for the next batch."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        known = now[3] < 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(now[2][known]), pa.array(-1 - now[3][known])], names=["_rid", "start"])
            now = [c[~known] for c in now]
        if not len(now[0]):
            continue
        rows = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
        rows = [c[order] for order in [np.lexsort(rows[::-1])] for c in rows]
        same = np.insert((rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1]), 0, False)
        yield pa.RecordBatch.from_arrays([pa.array(rows[2][same]), pa.array(rows[3][same])], names=["_rid", "start"])
        wait = ~same & (rows[0] == rows[0][-1])
        kept = [c[wait] for c in rows]


def _cut(size: int, schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the words of the windows at ``starts`` out of each text."""
    for batch in batches:
        rows = []
        for text, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            words, gone, kept = (text or "").encode("utf-8", "surrogatepass").split(), 0, None
            n = len(words)
            if starts.is_valid:
                edge, at = np.zeros(n + 1, np.int64), starts.values.to_numpy(zero_copy_only=False)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                out = np.cumsum(edge)[:-1] > 0
                words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                gone, kept = int(out.sum()), b" ".join(words).decode("utf-8", "surrogatepass")
            rows.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest(), kept))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, schema.field(i + 2).type) for i, c in enumerate(zip(*rows, strict=True)))], schema=schema)


def _removed(rows: DataFrame, kind: str, size: int) -> DataFrame:
    """(_rid, _id, n_words, n_removed, kept_sha256, kept_text) for rows (_rid, _id, _text); kept_text is null where nothing is removed."""
    spark = rows.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    out = spark.createDataFrame([], f"_rid long, _id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string").schema
    arrow = to_arrow_schema(out)
    shared = with_shared_places(rows.select("_rid", "_text"), lambda texts: symbol_names(size, texts))
    windows = shared.select("_rid", "_text", "_places").mapInArrow(lambda b: _find(size, b), "h1 long, h2 long, _rid long, start int")
    # One sort key, so that Spark sorts by radix; ties are settled in the stream.
    later = windows.repartition("h1").sortWithinPartitions("h1").mapInArrow(_later, "_rid long, start int")
    starts = materialise(later.groupBy("_rid").agg(F.collect_list("start").alias("starts")), "starts")
    release_shuffles(spark)
    return rows.join(starts, "_rid", "left").select("_rid", "_id", "_text", "starts").mapInArrow(lambda b: _cut(size, arrow, b), out)


def substring_digests(docs: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    Null and blank texts have no words; a text shorter than a window loses nothing. Repeated ids count as separate
    documents, ordered by text, null ids last: of two equal rows, the later one loses all its windows. Other columns are
    not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, rid = row_ids(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.select(F.col(rid).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _removed(rows, kind, size).select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of repeated windows taken out of ``text_col``; the words that stay are joined by one space.

    A text that loses nothing stays as it is, white space included. All columns are kept, whatever their names.
    """
    rows, rid = row_ids(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = _removed(rows.select(F.col(rid).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), kind, size)
    kept = free_name(rows, "_kept")
    out = rows.join(cut.where("kept_text is not null").select(F.col("_rid").alias(rid), F.col("kept_text").alias(kept)), rid, "left")
    return out.withColumn(text_col, F.coalesce(kept, text_col)).select(*docs.columns)
