"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. One differing bit moves one count by at most
one, so the Manhattan distance of the counts is a lower bound of the Hamming distance. Within radius 4, one half of the
segments has a Manhattan distance of at most 2, and two points at that distance have a lattice point within 1 of both. So
each distinct fingerprint is put, for each half, into its own grid cell and those next to it, and two linked fingerprints
meet in some cell, where their Hamming distance decides. Within a cell, pairs are compared in memory and only those that
tie two groups not yet tied are put out. Exact copies share a fingerprint and are never compared.

A cell of more than ``CELL`` fingerprints is not compared where it lies. Its fingerprints pass on to finer cells: of the
segments not yet used, one half again has a distance of at most 2. After three such steps, what still crowds in one cell is
dealt into blocks, and each pair of blocks is compared by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, small_batches
from .components import components

ODD = np.uint64(0x5555555555555555)
SEED = 42
#: Segments that tell cells apart are taken from so many, then from the half of them that is left, and so on.
WIDTHS = (32, 16, 8)
#: A cell is compared in one piece up to so many fingerprints: some 10**8 comparisons, half a megabyte.
CELL = 16_384
#: A component of more fingerprints than this is named by a map-side join, as its rows would crowd in one task.
CROWD = 10_000
LINKS = "a long, b long, cell long"


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned fingerprint: a bit is set if it is in over half of the shingles' XXH64 hashes; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        counts += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[batch.schema.names[0], "fp"])


def embed(fps: np.ndarray) -> np.ndarray:
    """The 32 bit counts as two-bit fields of one number."""
    return fps - ((fps >> np.uint64(1)) & ODD)


def _mixed(cell: np.ndarray, point: np.ndarray) -> np.ndarray:
    """One number for a cell and a point in it. Two cells with one number cost comparisons; the distance decides all the same."""
    x = (cell * np.uint64(0x9E3779B97F4A7C15)) ^ (point * np.uint64(0xC2B2AE3D27D4EB4F))
    return x ^ (x >> np.uint64(29))


def _cells(width: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, fp) for each cell that a fingerprint is in. A cell's last three bits tell where its unused segments start, in fours."""
    half, three = width // 2, np.uint64(7)
    low = np.uint64((1 << 2 * half) - 1)
    for batch in batches:
        cell, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
        point, start = embed(fps), (cell & three) * np.uint64(4)
        for first in (True, False):
            used, left = (start, start + np.uint64(half)) if first else (start + np.uint64(half), start)
            own = (point >> (np.uint64(2) * used)) & low
            points, who = [own], [np.arange(len(fps))]
            for k in range(half):
                step = np.uint64(1 << 2 * k)
                field = (own >> np.uint64(2 * k)) & np.uint64(3)
                for ok, moved in ((field < 2, own + step), (field > 0, own - step)):
                    points.append(moved[ok])
                    who.append(np.flatnonzero(ok))
            who = np.concatenate(who)
            found = (_mixed(cell[who], np.concatenate(points)) & ~three) | (left[who] // np.uint64(4))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(fps[who].view(np.int64))], names=["cell", "fp"])


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def tie(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int, forest: _Forest) -> list[tuple[int, int]]:
    """Links that tie what the forest has not tied yet, among fingerprints of one cell; rows are sorted by cell.

    Pairs are taken by their distance in the order: row i with row i + lag, as long as some cell has so many rows. Pairs of
    one group are left out before each lag, so a crowd of near copies costs comparisons, not rows; a cell that has become one
    group is done.
    """
    out, lag = [], 1
    bits = fp.view(np.uint64)
    _, place = np.unique(fp, return_inverse=True)
    group = np.arange(place.max() + 1 if len(place) else 0)
    at = np.flatnonzero(cell[:-1] == cell[1:])
    starts = np.flatnonzero(np.r_[len(cell) > 0, cell[1:] != cell[:-1]])
    which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cell)]))
    while len(at):
        if lag & (lag - 1) == 0:
            now = group[place]
            at = at[(np.minimum.reduceat(now, starts) != np.maximum.reduceat(now, starts))[which[at]]]
        tied = group[place[at]] == group[place[at + lag]]
        near = at[~tied][np.bitwise_count(bits[at[~tied]] ^ bits[at[~tied] + lag]) <= radius]
        for i in near.tolist():
            a, b = int(fp[i]), int(fp[i + lag])
            ga, gb = group[place[i]], group[place[i + lag]]
            if ga != gb:
                group[group == gb] = ga
                if forest.tie(a, b):
                    out.append((a, b))
        lag += 1
        at = at[at + lag < len(cell)]
        at = at[cell[at] == cell[at + lag]]
    return out


def _links(radius: int, limit: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, null), and (fp, null, cell) for what is in cells of more than ``limit`` rows. Rows come sorted by cell.

    The last cell of a batch waits for the next one, unless it is already too large: then its rows go straight through.
    """
    forest, kept, full = _Forest(), (np.empty(0, np.int64), np.empty(0, np.int64)), None

    def passed(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(cell)], names=["a", "b", "cell"])

    def settled(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, which, n = np.unique(cell, return_inverse=True, return_counts=True)
        large = (n > limit)[which]
        yield from passed(cell[large], fp[large])
        if found := cell_links(cell[~large], fp[~large], radius, forest):
            a, b = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(found), pa.int64())], names=["a", "b", "cell"])

    for batch in batches:
        cell, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if full is not None:
            cut = int(np.searchsorted(cell, full, "right"))
            yield from passed(cell[:cut], fp[:cut])
            cell, fp = cell[cut:], fp[cut:]
        if not len(cell):
            continue
        full = None
        cell, fp = (np.concatenate(x) for x in zip(kept, (cell, fp), strict=True))
        cut = int(np.searchsorted(cell, cell[-1]))
        yield from settled(cell[:cut], fp[:cut])
        kept = cell[cut:], fp[cut:]
        if len(kept[0]) > limit:
            full = int(cell[-1])
            yield from passed(*kept)
            kept = kept[0][:0], kept[1][:0]
    yield from settled(*kept)


def _block_pairs(crowds: DataFrame, limit: int) -> DataFrame:
    """(cell, fp) with a cell for each pair of blocks of a crowd, of three blocks or more; a block has about half of ``limit``."""
    blocks = crowds.groupBy("cell").agg(F.ceil(2 * F.count("*") / F.lit(limit)).cast("int").alias("n"))
    dealt = crowds.join(broadcast_if_small(blocks), "cell").withColumn("own", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    pairs = dealt.select("cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).where("own <> other")
    return pairs.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")


def fingerprint_links(fps: DataFrame, radius: int = 4, *, limit: int = CELL) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose graph has the same components as that of all pairs within ``radius`` (4 or less).

    ``limit`` only says how many fingerprints a task compares in one piece; the components are the same for each value.
    """
    if radius > 4:
        raise ValueError("two halves and one step guarantee radius 4 at most")

    def compared(cells: DataFrame, most: float) -> DataFrame:
        met = cells.repartition("cell").sortWithinPartitions("cell", "fp")
        return materialise(met.mapInArrow(lambda b: _links(radius, most, b), LINKS), "links")

    def finer(rows: DataFrame, width: int) -> DataFrame:
        return rows.mapInArrow(lambda b: _cells(width, b), "cell long, fp long")

    waiting, links = fps.select(F.lit(0).cast("long").alias("cell"), "fp").distinct(), []
    for width in WIDTHS:
        found = compared(finer(waiting, width), limit)
        links.append(found.where("cell is null").select("a", "b"))
        waiting = found.where("cell is not null").select("cell", F.col("a").alias("fp"))
        if waiting.isEmpty():
            break
    else:
        links.append(compared(_block_pairs(waiting, limit), float("inf")).select("a", "b"))
    return reduce(DataFrame.unionAll, links)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``; the component is named by its least id.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows give a row each. Null ids
    name no component unless no other id is in it. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fps = materialise(docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(lambda b: _fingerprints(shingle, b), f"_id {kind}, fp long"), "fingerprints")
    roots = components(fingerprint_links(fps, radius))
    least = fps.groupBy("fp").agg(F.min("_id").alias("least"))
    rooted = materialise(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "root"), "rooted")
    names = materialise(rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
    # Components are named beside their rows: crowds, of which there are few, by a map-side join; the others by a shuffle.
    crowds = broadcast_if_small(names.where(F.col("n") > CROWD).select("root", F.col("component_id").alias("crowd_id"), F.lit(True).alias("crowd")))
    linked = rooted.where("root is not null").join(crowds, "root", "left")
    named = reduce(
        DataFrame.unionAll,
        [
            rooted.where("root is null").select("fp", F.col("least").alias("component_id")),
            linked.where("crowd").select("fp", F.col("crowd_id").alias("component_id")),
            linked.where("crowd is null").join(names.where(F.col("n") <= CROWD), "root").select("fp", "component_id"),
        ],
    )
    return fps.join(named, "fp").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
