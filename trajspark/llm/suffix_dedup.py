"""Suffix-array dedup with sparse suffix arrays.

Suffixes are kept at content-selected places only: those whose five-word hash is least among eleven neighbouring ones, with
at least ``core`` words behind them. A passage that two places share and that has ``core`` + 10 words holds, within its
first eleven words, a place that is kept at both. Phase one drops suffixes whose first ``core`` words occur once. Phase two
sorts the others by what follows their core and compares neighbours: in a sorted order, the neighbours hold the longest
match. The same is done for the words before them, read backwards. A match needs at most eleven words either way, as
beyond that the passage has another kept suffix; the spans of all are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_ids
from .shared_places import by_size, firsts_and_others, release_shuffles, scattered, with_shared_places
from .words import BASES, mix, signed, text_of, window_hashes, word_names

GRAM, NEAR = 5, 11
MIN_WORDS = 50
ROW = "h1 long, h2 long, side int, context binary, known boolean, rid long, place long"


def kept_places(names: np.ndarray, edges: np.ndarray, core: int) -> np.ndarray:
    """Places of the least of ``NEAR`` neighbouring ``GRAM``-word hashes, the first of equals, with ``core`` words of their text from there."""
    n = int(edges[-1])
    if n < GRAM + NEAR:
        return np.empty(0, np.int64)
    h = window_hashes(names, GRAM, BASES[0])
    best, at = h[: len(h) - NEAR + 1].copy(), np.arange(len(h) - NEAR + 1)
    for k in range(1, NEAR):
        other = h[k : len(h) - NEAR + 1 + k]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    first = np.arange(len(at))
    inside = text_of(first, edges) == text_of(first + NEAR + GRAM - 2, edges)
    places = np.unique(at[inside])
    return places[places + core <= edges[text_of(places, edges) + 1]]


def suffix_names(core: int, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, _, edges = word_names(texts)
    places = kept_places(names, edges, core)
    which = text_of(places, edges)
    h = window_hashes(names, core, BASES[0])
    return (h[places] if len(places) else np.empty(0, np.uint64)), places - edges[which], which


def _contexts(names: np.ndarray, edges: np.ndarray, at: np.ndarray, rids: np.ndarray, core: int, side: int) -> np.ndarray:
    """32-bit names of the words behind the core (side 0) or before it, backwards (side 1); beyond the text, a number of its own."""
    which = text_of(at, edges)
    step = np.arange(NEAR)
    places = at[:, None] + core + step if side == 0 else at[:, None] - 1 - step
    inside = (places >= edges[which][:, None]) & (places < edges[which + 1][:, None])
    named = mix(names[np.where(inside, places, 0)]) >> np.uint64(32)
    alone = (scattered(rids, at - edges[which])[:, None] + step.astype(np.uint64)) >> np.uint64(32)
    return np.where(inside, named, alone).astype(">u4")


def _rows(core: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [r for r in batch.to_pylist() if r["_places"]]
        for part in by_size([r["_text"] for r in every]):
            some = every[part]
            names, more, edges = word_names([r["_text"] for r in some])
            counts = [len(r["_places"]) for r in some]
            place = np.fromiter((p for r in some for p in r["_places"]), np.int64, sum(counts))
            at, rid = place + np.repeat(edges[:-1], counts), np.repeat(np.array([r["_rid"] for r in some], np.int64), counts)
            h = [window_hashes(x, core, b)[at] for x, b in zip((names, more), BASES, strict=True)]
            for side in range(2):
                context = _contexts(names, edges, at, rid, core, side)
                # Rows that agree in all of core and context need no partner: one goes on to meet others, flagged.
                first, other = firsts_and_others(h[0], h[1], *(context[:, k] for k in range(NEAR)))
                h1 = np.where(other, scattered(rid, place * 2 + side), h[0])
                yield pa.RecordBatch.from_arrays([signed(h1), signed(h[1]), pa.array(np.full(len(at), side, np.int32)), pa.array([c.tobytes() for c in context], pa.binary()), pa.array(first | other), pa.array(rid), pa.array(place)], names=["h1", "h2", "side", "context", "known", "rid", "place"])


def _spans(core: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (side, h1, h2, context): each is compared with the one before and the one behind it."""

    def agree(a, b) -> np.ndarray:
        """Words of context in which rows agree, -1 where their cores differ."""
        same = (a["h1"] == b["h1"]) & (a["h2"] == b["h2"]) & (a["side"] == b["side"])
        equal = a["context"] == b["context"]
        return np.where(same, np.where(equal.all(1), NEAR, equal.argmin(1)), -1)

    def spans(rows, best) -> pa.RecordBatch:
        best = np.where(rows["known"], NEAR, best)
        ok = best >= 0
        low = rows["place"] - np.where(rows["side"] == 1, best, 0)
        high = rows["place"] + core + np.where(rows["side"] == 0, best, 0)
        return pa.RecordBatch.from_arrays([pa.array(rows["rid"][ok]), pa.array(low[ok]), pa.array(high[ok])], names=["_rid", "low", "high"])

    kept, kept_best = None, np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n != "context"}
        rows["context"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(-1, NEAR)
        if kept is not None:
            rows = {k: np.concatenate([kept[k], v]) for k, v in rows.items()}
        pairs = agree({k: v[:-1] for k, v in rows.items()}, {k: v[1:] for k, v in rows.items()})
        best = np.maximum(np.append(pairs, -1), np.insert(pairs, 0, -1))
        best[: len(kept_best)] = np.maximum(best[: len(kept_best)], kept_best)
        yield spans({k: v[:-1] for k, v in rows.items()}, best[:-1])
        kept, kept_best = {k: v[-1:] for k, v in rows.items()}, best[-1:]
    if kept is not None:
        yield spans(kept, kept_best)


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, n_words) of the spans that repeat, in one document or among several; all occurrences are listed.

    Every passage of ``min_words`` words (``[^\\x20\\x09-\\x0D]+``) that occurs twice is in a span; each word of a span is in a
    passage of ``min_words`` - 10 words that occurs twice; a span has ``min_words`` words at least. Null, blank and short
    texts have none. Repeated ids are separate documents, so equal rows repeat each other. Other columns are not read; an empty
    table gives an empty result.
    """
    core = min_words - NEAR + 1
    if core < GRAM + NEAR:
        raise ValueError("passages of less than 26 words are too short for these places")
    rows, rid = row_ids(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.select(F.col(rid).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = with_shared_places(rows.select("_rid", "_text"), lambda texts: suffix_names(core, texts)).where("_places is not null")
    suffixes = shared.mapInArrow(lambda b: _rows(core, b), ROW)
    found = suffixes.repartition("side", "h1").sortWithinPartitions("side", "h1", "h2", "context").mapInArrow(lambda b: _spans(core, b), "_rid long, low long, high long")
    sorted_spans = found.groupBy("_rid").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("s"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<low:bigint,high:bigint>>), (a, x) -> "
        "if(size(a) > 0 and element_at(a, -1).high >= x.low, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('low', element_at(a, -1).low, 'high', greatest(element_at(a, -1).high, x.high)))), "
        "concat(a, array(x))))"
    )
    spans = materialise(sorted_spans.select("_rid", F.explode(merged).alias("m")).where(F.col("m.high") - F.col("m.low") >= min_words).select("_rid", F.col("m.low").alias("start_word"), (F.col("m.high") - F.col("m.low")).alias("n_words")), "spans")
    release_shuffles(docs.sparkSession)
    return spans.join(rows.select("_rid", F.col("_id").alias(id_col)), "_rid").select(id_col, "start_word", "n_words")
