"""Cross-tokenizer alignment with id-striped dense count matrices.

Both tokenizers cut a text's bytes into tokens; bytes where both end a token cut the tokens into groups, and two tokens are
linked if their bytes overlap. A pair of ids counts in how many documents of the corpus it is linked, and the best partners of
an id are those of its greatest count. Texts are read once, and what they give is written to the shared folder: a row for each
text; the links of a batch of texts, dealt into stripes by the first tokenizer's id; and a task's own counts by stripe. Counts
of a stripe meet in one task that adds them into a dense block of the matrix, ids of the stripe by ids of the second tokenizer,
and gives its entries. Links of a stripe meet that block again and are scored by it and by its row maxima; a stripe with many links
is dealt out over several tasks, each with the block. Last, the scores of a batch's texts meet their rows.

Over the bytes of a batch of texts, the ends of either side's tokens are marked in two arrays. Between two marks next to each
other lies a piece of one token of either side, and no two pieces of the same two: pieces are links, and marks on both sides
end groups. Running counts of the marks give everything else without a loop over tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import Codec
from .common import materialise, small_batches
from .shared_places import by_size

#: Stripes of the first tokenizer's ids. A block has (ids / STRIPES) x (ids of the second) numbers of eight bytes.
STRIPES = 128
#: Characters of texts whose links make one row a stripe.
CHARS = 2_000_000
#: Distinct pairs that a task counts before it gives them out; entries of a block in one row.
PAIRS, ENTRIES = 2_000_000, 500_000
#: Links that one task scores with a block: between these bounds, a 256th of all.
LEAST, MOST = 100_000, 4_000_000
_BITS = np.uint64(20)
_MASK = np.uint64((1 << 20) - 1)
TEXT, LINKS, COUNTS = 0, 1, 2
SCHEMA = "kind int, batch long, stripe int, at array<int>, a array<int>, b array<int>, n array<long>, doc {id}, place int, n_a long, n_b long, n_groups long, n_links long, groups string"


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


@dataclass
class Aligned:
    """A batch of texts: bounds of each one's links, groups and tokens (both sides' in one row), links' ids, and a code for each token.

    Codes are numbers of ``Aligner.words``: in the order of groups, each one's tokens of the first side and then of the second.
    """

    links: np.ndarray
    groups: np.ndarray
    tokens: tuple[np.ndarray, np.ndarray]
    a: np.ndarray
    b: np.ndarray
    codes: np.ndarray


class Aligner:
    """Two tokenizer files: byte-level BPE, and pieces with a dummy prefix and byte fallback."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = Codec(a_path)
        # Strings of special tokens in a text are plain text here.
        self.a.special, self.a.lib.encode_special_tokens = [], True
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_piece = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(p) for p in self.b_piece], np.int64)
        self.widths = len(self.a.piece), len(pieces)
        if max(self.widths) > 1 << 20:
            raise ValueError("ids of more than 20 bits")
        # Each id with the sign behind it: inside a group, and at the end of its group's side.
        self.words = [b"%d%s" % (i, sign) for n, signs in zip(self.widths, ((b",", b"|"), (b",", b";")), strict=True) for sign in signs for i in range(n)]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where they don't give back a space and the text."""
        a, b, none = [], [], np.empty(0, np.int64)
        for text, x, y in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
            data = (" " + text).encode("utf-8", "surrogatepass")
            same = text and b"".join(map(self.b_piece.__getitem__, y)) == data and b"".join(map(self.a.piece.__getitem__, x.tolist())) == data
            a.append(x.astype(np.int64) if same else none)
            b.append(np.array(y, np.int64) if same else none)
        return a, b

    def align(self, texts: list[str]) -> Aligned:
        of_a, of_b = self.tokens(texts)
        sizes = [np.array([len(x) for x in side], np.int64) for side in (of_a, of_b)]
        bounds = [np.concatenate([[0], np.cumsum(n)]) for n in sizes]
        a, b = (np.concatenate([*side, np.empty(0, np.int64)]) for side in (of_a, of_b))
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b_size[b])
        total = int(a_end[-1]) if len(a) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[a_end], is_b[b_end] = True, True
        upto_a, upto_b, upto_both, upto_any = (np.cumsum(x) for x in (is_a, is_b, is_a & is_b, is_a | is_b))
        ends, common = np.flatnonzero(is_a | is_b), np.flatnonzero(is_a & is_b)
        text_end = np.concatenate([[0], a_end])[bounds[0]]
        group_a, group_b = upto_both[a_end - 1], upto_both[b_end - 1]
        before = np.concatenate([[0], upto_b[common]])
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before[group_a]] = a + self.widths[0] * is_b[a_end]
        codes[np.arange(len(b)) + upto_a[common[group_b]] if len(b) else slice(0)] = b + 2 * self.widths[0] + self.widths[1] * is_a[b_end]
        return Aligned(upto_any[text_end], upto_both[text_end], tuple(bounds), a[upto_a[ends - 1]], b[upto_b[ends - 1]], codes)

    def strings(self, found: Aligned) -> Iterator[bytes]:
        codes, word = found.codes.tolist(), self.words.__getitem__
        bounds = (found.tokens[0] + found.tokens[1]).tolist()
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield b"".join(map(word, codes[i:j]))[:-1]


def _striped(stripe: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(stripe, kind="stable")
    cuts = np.searchsorted(stripe[order], np.arange(STRIPES + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[s] : cuts[s + 1]]
        yield s, [c[own] for c in columns]


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _record(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _aligned(a_path: str, b_path: str, digest: bool, id_type: pa.DataType, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tool, context = aligner(a_path, b_path), TaskContext.get()
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = dict(kind=pa.int32(), batch=pa.int64(), stripe=pa.int32(), at=ints, a=ints, b=ints, n=longs, doc=id_type, place=pa.int32(), n_a=pa.int64(), n_b=pa.int64(), n_groups=pa.int64(), n_links=pa.int64(), groups=pa.string())
    schema = pa.schema(list(kinds.items()))
    pairs = np.empty(0, np.uint64), np.empty(0, np.int64)
    number = (context.partitionId() if context else 0) << 32

    def counts() -> Iterator[pa.RecordBatch]:
        keys, n = pairs
        a, b = (keys >> _BITS).astype(np.int32), (keys & _MASK).astype(np.int32)
        for s, (x, y, c) in _striped(a % STRIPES, a, b, n):
            yield _record([{"kind": COUNTS, "stripe": s, "a": x, "b": y, "n": c}], schema)

    for batch in batches:
        docs, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for part in by_size(texts, CHARS):
            number += 1
            found = tool.align(texts[part])
            m = len(found.links) - 1
            at = np.repeat(np.arange(m), np.diff(found.links))
            key, times = np.unique((at.astype(np.uint64) << np.uint64(40)) | (found.a.astype(np.uint64) << _BITS) | found.b.astype(np.uint64), return_counts=True)
            pair = key & np.uint64((1 << 40) - 1)
            a, b = (pair >> _BITS).astype(np.int32), (pair & _MASK).astype(np.int32)
            rows = [{"kind": LINKS, "batch": number, "stripe": s, "at": w, "a": x, "b": y, "n": c} for s, (w, x, y, c) in _striped(a % STRIPES, (key >> np.uint64(40)).astype(np.int32), a, b, times)]
            yield _record(rows, schema)
            strings = [hashlib.sha256(s).hexdigest() if s else "" for s in tool.strings(found)] if digest else [s.decode() for s in tool.strings(found)]
            counts_of = {"n_a": found.tokens[0], "n_b": found.tokens[1], "n_groups": found.groups, "n_links": found.links}
            texts_of = {"kind": pa.array([TEXT] * m, pa.int32()), "batch": pa.array([number] * m, pa.int64()), "doc": docs.slice(part.start, m), "place": pa.array(np.arange(m, dtype=np.int32)), "groups": pa.array(strings, pa.string())}
            texts_of |= {c: pa.array(np.diff(n).astype(np.int64)) for c, n in counts_of.items()}
            yield pa.RecordBatch.from_arrays([texts_of.get(f.name, pa.nulls(m, f.type)) for f in schema], schema=schema)
            pairs = _added(np.concatenate([pairs[0], pair]), np.concatenate([pairs[1], np.ones(len(pair), np.int64)]))
            if len(pairs[0]) > PAIRS:
                yield from counts()
                pairs = pairs[0][:0], pairs[1][:0]
    yield from counts()


class _Block:
    """A stripe's part of the count matrix: a row for each of its ids of the first tokenizer. Rows without a count are never looked at."""

    def __init__(self, a_ids: int, b_ids: int):
        self.counts, self.used = np.zeros((a_ids // STRIPES + 1, b_ids), np.int64), np.zeros(a_ids // STRIPES + 1, bool)

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.counts, (a // STRIPES, b), n)
        self.used[a // STRIPES] = True

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(self.used)
        own = self.counts[rows]
        row, b = np.nonzero(own)
        return rows[row], b, own[row, b]

    def maxima(self) -> np.ndarray:
        most, rows = np.zeros(len(self.used), np.int64), np.flatnonzero(self.used)
        most[rows] = self.counts[rows].max(axis=1, initial=0)
        return most

    def clear(self) -> None:
        self.counts[self.used] = 0
        self.used[:] = False


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _matrix(a_ids: int, b_ids: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the matrix by stripe; rows of counts come sorted by it."""
    block, now = _Block(a_ids, b_ids), None

    def entries() -> Iterator[pa.RecordBatch]:
        row, b, n = block.entries()
        a = row * STRIPES + now
        for i in range(0, len(a), ENTRIES):
            own = slice(i, i + ENTRIES)
            cols = [pa.array([now], pa.int32()), pa.array([a[own].astype(np.int32)], pa.list_(pa.int32())), pa.array([b[own].astype(np.int32)], pa.list_(pa.int32())), pa.array([n[own]], pa.list_(pa.int64())), pa.array([int(n[own].sum())])]
            yield pa.RecordBatch.from_arrays(cols, names=["stripe", "a", "b", "n", "load"])
        block.clear()

    for batch in batches:
        for i, s in enumerate(batch.column("stripe").to_pylist()):
            if s != now:
                if now is not None:
                    yield from entries()
                now = s
            block.add(*(_numbers(batch, c, i) for c in ("a", "b", "n")))
    if now is not None:
        yield from entries()


def _scored(a_ids: int, b_ids: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, at, n_best, count_sum) for each row of links; each cell's rows begin with its block's entries."""
    block, now, most = _Block(a_ids, b_ids), None, None
    kind = pa.list_(pa.int64())
    for batch in batches:
        for i, (cell, number) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("cell", "batch")], strict=True)):
            if cell != now:
                block.clear()
                now, most = cell, None
            a, b, n = (_numbers(batch, c, i) for c in ("a", "b", "n"))
            if number is None:
                block.add(a, b, n)
                continue
            if most is None:
                most = block.maxima()
            count = block.counts[a // STRIPES, b]
            at, which = np.unique(_numbers(batch, "at", i), return_inverse=True)
            best, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            np.add.at(best, which, np.where(count == most[a // STRIPES], n, 0))
            np.add.at(total, which, count * n)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([best], kind), pa.array([total], kind)], names=["batch", "at", "best", "total"])


def _summed(id_type: pa.DataType, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the sums of their scores; of each batch of texts, scores come before the texts."""
    now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        numbers = batch.column("batch").to_numpy(zero_copy_only=False)
        text = batch.column("kind").to_numpy(zero_copy_only=False) == TEXT
        cuts = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | ~text[1:] | ~text[:-1]]).tolist() + [len(numbers)] if len(numbers) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if numbers[i] != now:
                now, best, total = numbers[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
            at = batch.column("place").to_numpy(zero_copy_only=False)[i:j].astype(np.int64) if text[i] else _numbers(batch, "at", i)
            if len(at) and (grow := int(at.max()) + 1 - len(best)) > 0:
                best, total = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (best, total))
            if text[i]:
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("doc"), *[own.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(best[at]), pa.array(total[at]), own.column("groups")], names=["doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
            else:
                best[at] += _numbers(batch, "best", i)
                total[at] += _numbers(batch, "total", i)


def _written(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    return materialise(docs.select(id_col, text_col).mapInArrow(lambda t: _aligned(a_path, b_path, digest, arrow, t), SCHEMA.format(id=kind.simpleString())), "aligned")


def _counted(written: DataFrame, a_ids: int, b_ids: int) -> DataFrame:
    rows = written.where(F.col("kind") == COUNTS).select("stripe", "a", "b", "n").repartition("stripe").sortWithinPartitions("stripe")
    return materialise(rows.mapInArrow(lambda t: _matrix(a_ids, b_ids, t), "stripe int, a array<int>, b array<int>, n array<long>, load long"), "matrix")


def _widths(a_path: str, b_path: str) -> tuple[int, int]:
    return aligner(a_path, b_path).widths


def pair_counts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, best): each linked pair of ids, in how many rows of ``docs`` it is linked, and whether no partner of a has more."""
    counts = _counted(_written(docs, a_path, b_path, id_col, text_col, True), *_widths(a_path, b_path))
    pairs = counts.select(F.inline(F.arrays_zip("a", "b", F.col("n").alias("n_docs"))))
    return pairs.selectExpr("a", "b", "n_docs", "n_docs = max(n_docs) OVER (PARTITION BY a) AS best")


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of ``docs``.

    ``groups`` lists ``a1,a2|b1;a3|b2,b3`` in the text's order; with ``digest``, its SHA-256 in its place, ``groups_sha256``.
    Null and empty texts, and those whose tokens don't give back a space and the text, have no tokens: zeros and an empty
    string. Each row counts as a document of its own, repeated rows and null ids too. Other columns are not read; an empty table
    gives an empty result. All links of ties for the best count as best.
    """
    a_ids, b_ids = _widths(a_path, b_path)
    kind = docs.schema[id_col].dataType
    written = _written(docs, a_path, b_path, id_col, text_col, digest)
    matrix = _counted(written, a_ids, b_ids)
    loads = [tuple(r) for r in matrix.groupBy("stripe").agg(F.sum("load")).collect()]  # STRIPES rows at most
    piece = min(MOST, max(LEAST, sum(n for _, n in loads) // 256))
    shares = docs.sparkSession.createDataFrame([(s, -(-n // piece)) for s, n in loads], "stripe int, shares int")
    blocks = matrix.join(F.broadcast(shares), "stripe").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    links = written.where(F.col("kind") == LINKS).join(F.broadcast(shares), "stripe").withColumn("salt", F.pmod(F.xxhash64("batch"), "shares").cast("int"))
    cell = (F.col("stripe") + STRIPES * F.col("salt")).alias("cell")
    met = blocks.select(cell, F.lit(None).cast("long").alias("batch"), F.lit(None).cast("array<int>").alias("at"), "a", "b", "n").unionAll(links.select(cell, "batch", "at", "a", "b", "n"))
    scores = met.repartition("cell").sortWithinPartitions("cell", F.col("batch").asc_nulls_first()).mapInArrow(lambda t: _scored(a_ids, b_ids, t), "batch long, at array<int>, best array<long>, total array<long>")
    text = ["doc", "place", "n_a", "n_b", "n_groups", "n_links", "groups"]
    rows = written.where(F.col("kind") == TEXT).select("batch", "kind", *text).unionByName(scores.withColumn("kind", F.lit(LINKS)), allowMissingColumns=True)
    arrow = to_arrow_type(kind)
    out = rows.repartition("batch").sortWithinPartitions("batch", F.col("kind").desc()).mapInArrow(lambda t: _summed(arrow, t), f"doc {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("doc", id_col).withColumnRenamed("groups", "groups_sha256" if digest else "groups")
