"""MinHash near-duplicates by fast similarity sketching.

A sketch has 128 coordinates. In round i each shingle of a set is thrown into one coordinate by a hash of that round, with a
value; the least value stays, and a coordinate once filled is never changed by a later round. After as many rounds as
coordinates, round 128 + i throws all shingles into coordinate i, so that every coordinate is filled, and filled by a
shingle that is as good as drawn from the set; two sets agree in a coordinate with a probability equal to their similarity,
and the number of agreements is concentrated about it. Large sets are done after a round or two.

Sets that share a band of four coordinates meet. In a bucket, all are compared with the one that meets most others, on their
full sets of shingles; what that has not tied together meets again, without the one that everyone has been compared with. When
such a round ties little, those that are still apart are taken in blocks, and pairs whose sketches agree in 80 coordinates are
compared, but for those that the task has tied by then. Equal sets are one node from the start, so copies cost nothing.

32 bands leave out a pair at a similarity of 0.8 with a probability of 5e-8 (at 0.85: 6e-11); 80 agreements, five deviations
below the mean, another 1e-6 of the pairs that only the last step sees. No pair is linked that does not reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_keyed, materialise, row_ids, small_batches
from .components import components
from .shared_places import by_size
from .words import BASES, mix, signed, window_hashes, word_names

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Agreeing coordinates that a pair has to have in the last step.
AGREE = 80
#: Rounds in which a bucket is compared with its first member, before blocks are; and the share of links that is worth one more.
PIVOTS, WORTH = 8, 0.02
#: Sets of one block in the last step, and their shingles: two blocks are some tens of megabytes.
BLOCK, SHINGLES = 1024, 1_000_000
#: Pairs that one copy of a frequent member's text is joined with.
PARTNERS = 2_000
_EMPTY = np.uint64(2**64 - 1)


@lru_cache(maxsize=2)
def _salts(n: int) -> np.ndarray:
    return np.random.default_rng(13).integers(1, 2**63, n, dtype=np.int64).astype(np.uint64)


def sketches(names: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of ``COORDINATES`` for each set of distinct 64-bit names between two edges; a set without names has an empty row."""
    t = COORDINATES
    out = np.full((len(edges) - 1, t), _EMPTY)
    of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for i in range(2 * t):
        if not len(names):
            break
        h = mix(names ^ _salts(2 * t)[i])
        at = (h >> np.uint64(57)).astype(np.int64) if i < t else np.full(len(h), i - t)
        now = np.full(out.shape, _EMPTY)
        # The upper seven bits have named the coordinate: the value is the rest, mixed once more.
        np.minimum.at(now.reshape(-1), of * t + at, mix(h) >> np.uint64(1))
        out = np.where(out == _EMPTY, now, out)
        open_ = (out == _EMPTY).any(1)[of]
        names, of = names[open_], of[open_]
    return out


def shingle_names(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text by two names, all in a row, and the edges between texts. Fewer words: the whole sequence is one."""
    lowered = [(t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
    one, two, edges = word_names(lowered)
    first = window_hashes(one, shingle, BASES[0]), window_hashes(two, shingle, BASES[1])
    found, sizes = [[], []], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= shingle:
            x, at = np.unique(first[0][a : b - shingle + 1], return_index=True)
            y = first[1][a : b - shingle + 1][at]
        elif b > a:
            x, y = (mix(window_hashes(n[a:b], b - a, base) + np.uint64(b - a)) for n, base in zip((one, two), BASES, strict=True))
        else:
            x = y = np.empty(0, np.uint64)
        found[0].append(x)
        found[1].append(y)
        sizes.append(len(x))
    none = [np.empty(0, np.uint64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _sketched(shingle: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for part in by_size(texts):
            one, two, edges = shingle_names(texts[part], shingle)
            low = (sketches(one, edges) & np.uint64(0xFFFF)).astype("<u2")
            total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x))]) for x in (one, two)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids[part]), pa.array(np.diff(edges)), *[signed(s[edges[1:]] - s[edges[:-1]]) for s in total], pa.array([row.tobytes() for row in low], pa.binary())],
                names=["rid", "n", "one", "two", "sketch"],
            )


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
        keys = mix(rows ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))
        yield pa.RecordBatch.from_arrays([signed(keys.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "rep"])


def shingle_set(text: str, shingle: int) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(w) for w in zip(*[words[i:] for i in range(shingle)], strict=False)}


def _verified(shingle: int, percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets, as sets of strings, reach the threshold. Rows come sorted by their first member."""
    held, mine = None, set()
    for batch in batches:
        out = []
        for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if a != held:
                held, mine = a, shingle_set(x, shingle)
            other = shingle_set(y, shingle)
            if 100 * min(len(mine), len(other)) >= percent * max(len(mine), len(other)):
                both = len(mine & other)
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    out.append((a, b))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified_links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts (rep, text) reach the threshold. A member of many pairs is dealt out over several tasks."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    held = materialise(texts.join(broadcast_if_small(ids), "rep", "left_semi"), "texts")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("shares"))
    many = broadcast_if_small(shares.where("shares > 1"))
    salted = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    copies = held.withColumnRenamed("rep", "a").join(many, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).select("a", "salt", F.col("text").alias("x"))
    met = salted.join(held.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b").join(copies, ["a", "salt"])
    found = met.select("a", "b", "x", "y").sortWithinPartitions("a").mapInArrow(lambda t: _verified(shingle, percent, t), "a long, b long")
    return materialise(found, "links")


def _tied(shingle: int, percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that tie what isn't tied yet, of each pair of blocks; rows come sorted by it. Only members of two blocks, if there are two.

    Pairs whose sketches agree often enough are compared by the names of all their shingles.
    """

    def compared(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, rep, root, own, sketch, texts = rows
        two, out = (own != own[0]).any(), []
        names, _, edges = shingle_names(texts.tolist(), shingle)
        n, (_, group) = np.diff(edges), np.unique(root, return_inverse=True)
        for i in range(len(rep) - 1):
            ok = (group[i + 1 :] != group[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :]))
            at = np.flatnonzero(ok & (own[i + 1 :] != own[i]) if two else ok) + i + 1
            at = at[np.count_nonzero(sketch[at] == sketch[i], axis=1) >= AGREE]
            if not len(at):
                continue
            mine = names[edges[i] : edges[i + 1]]
            others = names[np.repeat(edges[at] - np.concatenate([[0], np.cumsum(n[at])[:-1]]), n[at]) + np.arange(n[at].sum())]
            hit = mine[np.minimum(np.searchsorted(mine, others), len(mine) - 1)] == others
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n[at])[:-1]]))
            for j in at[100 * both >= percent * (n[i] + n[at] - both)].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    kept: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        rows += [np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u2").reshape(-1, COORDINATES), np.array(batch.column(5).to_pylist(), object)]
        rows = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]).tolist()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield from compared([r[a:b] for r in rows])
        kept = [r[starts[-1] :] for r in rows]
    if kept is not None:
        yield from compared(kept)


def block_links(met: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that tie members (key, rep, root) of a bucket with unlike roots, found all against all in blocks.

    A block has ``BLOCK`` members at most or so, and ``SHINGLES`` shingles unless one text has more.
    """
    met = met.join(nodes.select("rep", "n", "sketch"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(SHINGLES))).cast("int")
    sizes = met.groupBy("key").agg(blocks.alias("blocks"), F.count("*").alias("size"))
    dealt = join_keyed(met, sizes, "key", "size").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "rep", "root", "own", "sketch")
    held = materialise(texts.join(broadcast_if_small(met.select("rep").distinct()), "rep", "left_semi"), "texts")
    rows = cells.join(held, "rep").select("cell", "rep", "root", "own", "sketch", "text").repartition("cell").sortWithinPartitions("cell", "rep")
    return materialise(rows.mapInArrow(lambda t: _tied(shingle, percent, t), "a long, b long"), "links")


def links(nodes: DataFrame, texts: DataFrame, *, shingle: int = 4, percent: int = 80, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) between distinct sets whose graph has the components of all links. ``nodes``: rep, n, sketch; ``texts``: rep, text."""
    bands = nodes.select("rep", "sketch").mapInArrow(_bands, "key long, rep long")
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(join_keyed(bands, sizes, "key", "size"), "buckets")
    # A text that others were made from is in the fullest bucket of every band: its rank is the sum of its buckets' sizes.
    ranks = met.groupBy("rep").agg(F.sum("size").alias("rank"))
    met = materialise(met.join(ranks, "rep").select("key", "rep", F.col("rep").alias("root"), "rank"), "buckets")
    found: list[DataFrame] = []
    for _ in range(pivots):
        pivot = met.groupBy("key").agg(F.max(F.struct("rank", "rep", "root")).alias("first"), F.count("*").alias("size"))
        beside = join_keyed(met, pivot, "key", "size").where("rep <> first.rep").select("key", "rep", "root", "rank", F.col("first.rep").alias("a"), F.col("first.root").alias("other"))
        found.append(verified_links(beside.where("root <> other").select("a", F.col("rep").alias("b")), texts, shingle, percent))
        roots = components(reduce(DataFrame.unionAll, found))
        rest = materialise(beside.select("key", "rep", "rank").join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root"), "rank"), "rest")
        apart = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
        met = materialise(join_keyed(rest, apart, "key", "size").select("key", "rep", "root", "rank"), "buckets")
        if met.isEmpty():
            return reduce(DataFrame.unionAll, found)
        if found[-1].count() < WORTH * met.select("rep").distinct().count():
            break
    found.append(block_links(met.select("key", "rep", "root"), nodes, texts, shingle, percent))
    return reduce(DataFrame.unionAll, found)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80, pivots: int = PIVOTS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``: sets of distinct shingles with ``percent`` of their union in common are linked.

    A text of fewer words than a shingle is one shingle; null, empty and blank texts have none, are linked with nothing and
    are kept. Repeated rows give a row each; of rows with one id that are linked, all have that id as component and are kept. A
    null id names a component only if no other is in it. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows, rid = row_ids(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = materialise(rows.select("rid", "text").mapInArrow(lambda b: _sketched(shingle, b), "rid long, n long, one long, two long, sketch binary"), "sets")
    groups = sets.where("n > 0").groupBy("n", "one", "two").agg(F.min("rid").alias("rep"), F.count("*").alias("size"), F.first("sketch").alias("sketch"))
    nodes = materialise(groups.withColumn("set", F.xxhash64("one", "two", "n")), "nodes")
    roots = components(links(nodes.select("rep", "n", "sketch"), rows.select(F.col("rid").alias("rep"), "text"), shingle=shingle, percent=percent, pivots=pivots))
    rooted = materialise(nodes.join(roots, F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("root", "rep").alias("root"), "size"), "rooted")
    named = join_keyed(sets.where("n > 0").select("rid", "n", "one", "two"), rooted, ["n", "one", "two"], "size").select("rid", "n", "root")
    every = named.unionAll(sets.where("n = 0").select("rid", "n", F.col("rid").alias("root")))
    if rows.where(~F.equal_null(F.col("rid"), F.col("_id"))).isEmpty():  # unique whole numbers: rows need no other names
        return every.select(F.col("rid").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.col("root").cast(docs.schema[id_col].dataType).alias("component_id"), (F.col("rid") == F.col("root")).alias("kept"))
    own = every.join(rows.select("rid", "_id"), "rid").select("rid", "n", "root", "_id")
    heads = own.where("rid = root").select("root", F.col("_id").alias("component_id"))
    return own.join(heads, "root").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.equal_null("_id", "component_id").alias("kept"))

