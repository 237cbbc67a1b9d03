"""Ranked lexical search of a set of items over all documents, by a threshold-seeded join.

Documents are read once; what stays of each is its postings of the items' terms, kept document by document. From them come,
for each term, its document count, its greatest impact and the k greatest impacts (the part of a score that depends on the
document). The k-th impact of one term of an item is a bound that its k-th score cannot be below: the seed of its
threshold. An item's terms are put in order of their greatest share of a score; the last of them that together stay below the
threshold are pruned: no document that has only these can be among the first k. The other terms are joined with the postings and
give candidates with a part of their score; a candidate stays if that part, with the most that the pruned terms could add, reaches
the threshold, and is then scored exactly. Each task keeps its own k best for an item and raises its threshold with them;
the best of all tasks are ranked at the end. All comparisons are of whole numbers, and equal scores are never pruned.

Items are taken in blocks of a bounded number of terms, so what a task is given of them is bounded; every block sees every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, row_ids, small_batches

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Everything else becomes a space, A-Z their small letters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms of items, counted by item, in one block: some tens of MB in a task.
BLOCK_TERMS = 200_000
#: Postings that are joined with the items' terms at once.
POSTINGS = 200_000
#: Fixed values of the score: a document's length is 10 + 90 * n / mean, and a term's share saturates with 8 thousandths of it.
WEIGHT, PART, SLOPE, TF, LENGTH = 1000, 1_000_000_000, 90, 1000, 8


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Items:
    """A block of items: their terms' numbers, and for each term the items that have it (rows of ``item`` from ``start``)."""

    terms: list[bytes]
    start: np.ndarray
    item: np.ndarray
    size: int

    @staticmethod
    def of(rows: list[tuple[int, list[bytes]]]) -> Items:
        pairs = sorted((t, i) for i, ts in rows for t in ts)
        terms = sorted({t for t, _ in pairs})
        place = {t: k for k, t in enumerate(terms)}
        start = np.searchsorted(np.array([place[t] for t, _ in pairs], np.int64), np.arange(len(terms) + 1))
        return Items(terms, start, np.array([i for _, i in pairs], np.int64), 1 + max((i for i, _ in rows), default=-1))


def parts_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a document adds for a term, but for the term's weight."""
    return (PART * tf) // (TF * tf + LENGTH * m)


def _postings(terms: list[bytes], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document number, its terms with repeats, numbers of the items' terms in it, how often each) for each document with a term."""
    known = {t: k for k, t in enumerate(terms)}
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(terms_of(text))
            if found:
                own = [(known[t], c) for t, c in found.items() if t in known] if len(found) < len(known) else [(k, found[t]) for t, k in known.items() if t in found]
                rows.append((doc, found.total(), [k for k, _ in own], [c for _, c in own]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc", "n", "term", "tf"])


def _flat(batch: pa.RecordBatch, total: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents' numbers, and for each posting its document's place, term and part; in pieces of about ``POSTINGS``."""
    doc, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    # 90 * n * N is past 64 bits only where 10**10 documents meet a text of 10**7 terms.
    m = 100 - SLOPE + (SLOPE * n * count) // max(total, 1)
    low = 0
    while low < len(doc):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + POSTINGS, "right")) - 1)
        at = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        own = slice(ends[low], ends[high])
        yield doc[low:high], at, term[own], parts_of(tf[own], m[low:high][at])
        low = high


def _impacts(vocabulary: int, k: int, total: int, count: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that have it, its k greatest parts) of one task's documents."""
    best, df = np.zeros((vocabulary, k), np.int64), np.zeros(vocabulary, np.int64)
    for batch in batches:
        for _, _, term, part in _flat(batch, total, count):
            df += np.bincount(term, minlength=vocabulary)
            order = np.lexsort((-part, term))
            term, part = term[order], part[order]
            rank = np.arange(len(term)) - np.searchsorted(term, term)
            new = rank < k
            held = np.unique(term)
            mine = np.zeros((len(held), 2 * k), np.int64)
            mine[:, :k] = best[held]
            mine[np.searchsorted(held, term[new]), k + rank[new]] = part[new]
            best[held] = -np.sort(-mine, axis=1)[:, :k]
    seen = np.flatnonzero(df)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen]), pa.array(best[seen].tolist(), pa.list_(pa.int64()))], names=["term", "df", "parts"])


@dataclass
class Plan:
    """What a task needs to search: weights, the terms that give candidates, and what the pruned ones can add at most."""

    items: Items
    weight: np.ndarray
    needed: np.ndarray  # for each row of items.item: whether the term gives candidates for the item
    rest: np.ndarray  # for each item: the most that its pruned terms add
    threshold: np.ndarray  # for each item: what the k-th score is not below


def plan(items: Items, weight: np.ndarray, kth: np.ndarray, most: np.ndarray) -> Plan:
    """Seeds thresholds by the terms' k-th parts and prunes each item's terms by the sums of their greatest shares."""
    term = np.repeat(np.arange(len(items.terms)), np.diff(items.start))
    threshold = np.zeros(items.size, np.int64)
    np.maximum.at(threshold, items.item, weight[term] * kth[term])
    share = weight[term] * most[term]
    order = np.lexsort((share, items.item))
    sums = np.cumsum(share[order])
    first = np.searchsorted(items.item[order], items.item[order])
    below = sums - np.where(first > 0, sums[first - 1], 0)
    needed, rest = np.ones(len(term), bool), np.zeros(items.size, np.int64)
    pruned = below < np.maximum(threshold, 1)[items.item[order]]  # a score of 0 is no result
    needed[order[pruned]] = False
    np.maximum.at(rest, items.item[order[pruned]], below[pruned])
    return Plan(items, weight, needed, rest, threshold)


def _joined(p: Plan, at: np.ndarray, term: np.ndarray, part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For postings and the rows of ``items.item`` of their terms that count: (document's place * items + item, share), one a match."""
    kept = np.concatenate([[0], np.cumsum(rows)])
    start = kept[p.items.start]
    n = (start[1:] - start[:-1])[term]
    item = p.items.item[rows]
    where = np.repeat(start[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.repeat(at, n) * p.items.size + item[where], np.repeat(p.weight[term] * part, n)


def _summed(key: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, share = key[order], share[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(share, first) if len(first) else share


def _found(p: Plan, k: int, total: int, count: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's k best documents (item, doc, score) of each item."""
    held = [np.empty(0, np.int64)] * 3
    threshold = p.threshold.copy()
    for batch in batches:
        for doc, at, term, part in _flat(batch, total, count):
            key, low = _summed(*_joined(p, at, term, part, p.needed))
            item = key % p.items.size
            key = key[low + p.rest[item] >= np.maximum(threshold[item], 1)]
            if not len(key):
                continue
            # Exactly: the postings of the candidates' documents, with all terms of the items.
            wanted = np.zeros(len(doc), bool)
            wanted[key // p.items.size] = True
            own = wanted[at]
            every, share = _joined(p, at[own], term[own], part[own], np.ones(len(p.needed), bool))
            place = np.minimum(np.searchsorted(key, every), len(key) - 1)
            hit = key[place] == every
            score = np.zeros(len(key), np.int64)
            np.add.at(score, place[hit], share[hit])
            item = key % p.items.size
            good = score >= np.maximum(threshold[item], 1)
            held = [np.concatenate(x) for x in zip(held, (item[good], doc[key[good] // p.items.size], score[good]), strict=True)]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [h[order] for h in held]
            rank = np.arange(len(order)) - np.searchsorted(held[0], held[0])
            held = [h[rank < k] for h in held]
            last = rank[rank < k] == k - 1
            threshold[held[0][last]] = np.maximum(threshold[held[0][last]], held[2][last])
    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()) for h in held], names=["item", "doc", "score"])


def _block(docs: DataFrame, rows: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """(item, doc, score, rank) of one block of items. ``docs``: doc (a number that sorts like the id), text."""
    items = Items.of(rows)
    postings = materialise(docs.mapInArrow(lambda b: _postings(items.terms, b), "doc long, n long, term array<int>, tf array<int>"), "postings")
    stats = postings.agg(F.count("*").alias("count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    count, total, v = stats["count"], stats["total"], len(items.terms)
    parts = postings.mapInArrow(lambda b: _impacts(v, k, total, count, b), "term int, df long, parts array<long>")
    # k numbers from each task: no term's are more than that, and no more terms than the block has come to the driver.
    merged = parts.groupBy("term").agg(F.sum("df").alias("df"), F.slice(F.sort_array(F.flatten(F.collect_list("parts")), asc=False), 1, k).alias("parts"))
    weight, kth, most = np.zeros(v, np.int64), np.zeros(v, np.int64), np.zeros(v, np.int64)
    for r in merged.collect():
        weight[r.term] = math.floor(WEIGHT * math.log((2 * count + 2) / (2 * r.df + 1)))
        kth[r.term] = r.parts[k - 1] if len(r.parts) >= k else 0
        most[r.term] = r.parts[0]
    p = plan(items, weight, kth, most)
    found = postings.mapInArrow(lambda b: _found(p, k, total, count, b), "item long, doc long, score long")
    return found.selectExpr("item", "doc", "score", "row_number() OVER (PARTITION BY item ORDER BY score DESC, doc) AS rank").where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of the highest score for each row of ``items``, of those with a score above 0.

    Equal scores are ranked by id, null ids last. Null and empty texts have no terms and are found by nothing; an item without
    terms, or whose terms no document has, finds nothing. Each row of ``docs`` is a document and each row of ``items`` an item,
    so repeated rows are found, or ask, once each. Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    number = free_name(items, "_item")
    asked = materialise(items.select(F.col(item_col), F.col(item_text).alias("_item_text")).withColumn(number, F.monotonically_increasing_id()), "items")
    asked = asked.withColumn("_terms", F.array_distinct(F.split(F.translate(F.regexp_replace(F.coalesce("_item_text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), " "))).withColumn("_terms", F.array_remove("_terms", ""))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("_terms"))).first()[0] or 0) / block))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if docs.schema[id_col].dataType.typeName() in ("long", "integer") and docs.where(F.col(id_col).isNull()).limit(1).isEmpty():
        numbered, ids = texts.select(F.col("_id").cast("long").alias("doc"), F.col("_text").alias("text")), None
    else:
        rows, rid = row_ids(texts, "_id", "_text")
        numbered, ids = rows.select(F.col(rid).alias("doc"), F.col("_text").alias("text")), rows.select(F.col(rid).alias("doc"), "_id")
    out = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64(number), F.lit(blocks)) == b)
        rows = own.select(number, "_terms").collect()  # one block: bounded by its terms
        found = _block(numbered, [(i, [t.encode() for t in r[1]]) for i, r in enumerate(rows)], k)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item long, `{number}` long")
        out.append(found.join(F.broadcast(names), "item").drop("item"))
    found = reduce(DataFrame.unionAll, out).join(asked.select(number, item_col), number)
    found = found.withColumn("_id", F.col("doc").cast(docs.schema[id_col].dataType)) if ids is None else found.join(ids, "doc")
    return found.select(item_col, F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
