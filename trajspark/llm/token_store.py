"""Token-ID output: a content-addressed store of id streams.

A document's ids are cut where a rolling hash of the last 32 ids is small. A chunk's address is the BLAKE2b digest of its
bytes. The store is one Parquet table in three folders:

* ``kind=own``: documents whose chunks occur nowhere else. Their recipe (addresses, lengths), Merkle root and ids.
* ``kind=ref``: documents that hold a chunk which occurs more than once; only their other chunks stand with them.
* ``kind=chunk``: chunks that occur more than once, stored once each.

So every distinct chunk is stored once, and reading most documents needs no join. Rows are in ascending order of the id:
``part`` numbers the range partitions, ``start`` counts a part's ids before the document. ``manifest`` (a second table) has
for each part its documents, ids, the ids of all parts before it, and a Merkle root over its documents' roots. ``meta`` (one
row) has the type of the document ids, the bytes of an id, the number of parts and the Merkle root over the parts' roots:
one value that stands for the whole store.

Steps: encode once and write (staging); count addresses from the staged recipes (no ids read); one range shuffle brings
staged documents and their list of shared chunks together in id order; write. Two copies of the ids exist at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, cut_places
from .common import _delete, broadcast_if_small, row_ids, scratch_path, small_batches

#: Ids in a chunk, on average; chunks have 32 at least but for a document's last.
MEAN_IDS = 512
STAGED = "_rid long, {id} {kind}, n_tokens long, hashes array<binary>, sizes array<int>, ids binary"
FINAL = "kind string, part int, _rid long, {id} {type}, start long, n_tokens long, hashes array<binary>, sizes array<int>, shared array<int>, root binary, ids binary"


MANIFEST = "part int, n_docs long, n_tokens long, before long, root string"
META = "id_type string, width int, n_parts long, root string"


def address(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over addresses: pairs are hashed level by level, an odd last one moves up; no leaf: the hash of nothing."""
    tree = MerkleTree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


class MerkleTree:
    """The root of leaves that come one by one; holds one hash for each level."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.peaks and self.peaks[-1][0] == level:
            leaf, level = address(b"\1" + self.peaks.pop()[1] + leaf), level + 1
        self.peaks.append((level, leaf))

    def root(self) -> bytes:
        if not self.peaks:
            return address(b"")
        out = self.peaks[-1][1]
        for _, peak in self.peaks[-2::-1]:
            out = address(b"\1" + peak + out)
        return out


def chunk_edges(ids: np.ndarray, mean: int = MEAN_IDS) -> list[int]:
    cuts = cut_places((ids + np.uint32(1)) * np.uint32(0x9E3779B1), mean)
    return [0, *cuts.tolist(), len(ids)] if len(ids) else [0]


def _stage(path: str, end: int | None, dtype: str, names: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    tail = np.array([] if end is None else [end], np.uint32)
    for batch in batches:
        n, hashes, sizes, data = [], [], [], []
        for ids in code.encode([t or "" for t in batch.column(2).to_pylist()]):
            ids = np.concatenate([ids, tail])
            if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                raise ValueError(f"id {ids.max()} does not fit into {np.dtype(dtype).itemsize} bytes; write a wide store")
            edges, raw = chunk_edges(ids), ids.astype(dtype).tobytes()
            w = len(raw) // max(len(ids), 1)
            n.append(len(ids))
            sizes.append(np.diff(edges).astype(np.int32))
            hashes.append([address(raw[a * w : b * w]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            data.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hashes, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(data, pa.binary())], names=names)


def _seal(width: int, schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range partition, in order: a document's list of shared chunks, if any, comes before the document."""
    start, lists = 0, (None, {})
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["ids"] is None:
                lists = (r["_rid"], dict(zip(r["places"], r["first"], strict=True)))
                continue
            shared = lists[1] if lists[0] == r["_rid"] else {}
            own, at, ids = [], 0, r["ids"]
            blank = dict.fromkeys(schema.names)
            for i, (h, n) in enumerate(zip(r["hashes"], r["sizes"], strict=True)):
                piece = ids[at : at + n * width]
                at += n * width
                if i not in shared:
                    own.append(piece)
                elif shared[i]:
                    rows.append(blank | {"kind": "chunk", "part": r["part"], "hashes": [h], "ids": piece})
            rows.append({k: r.get(k) for k in schema.names} | {"kind": "ref" if shared else "own", "start": start, "shared": sorted(shared), "root": merkle_root(r["hashes"]), "ids": b"".join(own)})
            start += r["n_tokens"]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_store(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the store to ``path``, in ascending order of ``id_col`` (nulls last).

    Null and empty texts have only the end id. Repeated ids are separate documents, ordered by text; other columns are not
    read. An empty table gives a store without parts. ``wide``: ids of 4 bytes instead of 2, for vocabularies beyond 65,536; an
    id that doesn't fit stops the job.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind, dtype = docs.schema[id_col].dataType.simpleString(), "<u4" if wide else "<u2"
    rows, rid = row_ids(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.select(F.col(rid).alias("_rid"), F.col(id_col).alias("_id"), text_col)
    staged_at = scratch_path(spark, "staged")
    names = ["_rid", "_id", "n_tokens", "hashes", "sizes", "ids"]
    staged = rows.mapInArrow(lambda b: _stage(tokenizer, end_id, dtype, names, b), STAGED.format(id="_id", kind=kind))
    staged.write.option("compression", "zstd").parquet(staged_at)
    staged = spark.read.schema(staged.schema).parquet(staged_at)

    places = staged.select("_rid", F.posexplode("hashes").alias("place", "hash"))
    several = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("_rid", "place")).alias("first")).where("n > 1").select("hash", "first")
    lists = places.join(several, "hash").groupBy("_rid").agg(F.collect_list(F.struct("place", ((F.col("first._rid") == F.col("_rid")) & (F.col("first.place") == F.col("place"))).alias("first"))).alias("l"))
    lists = lists.select("_rid", F.col("l.place").alias("places"), F.col("l.first").alias("first"))
    ordered = staged.unionByName(lists, allowMissingColumns=True).withColumn("late", F.col("ids").isNotNull())
    ordered = ordered.repartitionByRange("_rid").sortWithinPartitions("_rid", "late").drop("late").withColumn("part", F.spark_partition_id())
    final = FINAL.format(id="_id", type=kind)
    schema = spark.createDataFrame([], final).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, width = to_arrow_schema(schema), 4 if wide else 2
    ordered.mapInArrow(lambda b: _seal(width, arrow, b), schema).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/store")
    _delete(spark, staged_at)
    parts = _parts(spark.read.schema(schema).parquet(f"{path}/store"))
    spark.createDataFrame(parts, MANIFEST).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(kind, width, *_whole(parts))], META).write.parquet(f"{path}/meta")


def _meta(spark: SparkSession, path: str):
    try:
        return spark.read.schema(META).parquet(f"{path}/meta").first()
    except Exception as e:
        raise ValueError(f"{path} holds no store") from e


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINAL.format(id="_id", type=_meta(spark, path).id_type)).parquet(f"{path}/store")


def _part_roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents come sorted by (part, number); one row for each part."""
    part = tree = None
    docs = tokens = 0
    row = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()), "first_rid": pa.array([first], pa.int64()), "root": [tree.root().hex()]})
    for batch in batches:
        for p, rid, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if tree:
                    yield row()
                part, first, tree, docs, tokens = p, rid, MerkleTree(), 0, 0
            tree.add(root)
            docs, tokens = docs + 1, tokens + n
    if tree:
        yield row()


def _parts(store: DataFrame) -> list[tuple]:
    """(part, n_docs, n_tokens, ids of all parts before it, root) in the order of the documents: as many rows as parts."""
    docs = store.where("kind in ('own', 'ref')").select("part", "_rid", "n_tokens", "root")
    found = docs.repartition("part").sortWithinPartitions("part", "_rid").mapInArrow(_part_roots, "part int, n_docs long, n_tokens long, first_rid long, root string")
    before, out = 0, []
    for r in sorted(found.collect(), key=lambda r: r["first_rid"]):
        out.append((r["part"], r["n_docs"], r["n_tokens"], before, r["root"]))
        before += r["n_tokens"]
    return out


def _whole(parts: list[tuple]) -> tuple[int, str]:
    return len(parts), merkle_root([bytes.fromhex(p[-1]) for p in parts]).hex()


def _assemble(dtype: str, names: list[str], digest: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = np.dtype(dtype).itemsize
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            if r["shared"]:
                fetched, pieces, at = {x["place"]: x["ids"] for x in r["fetched"] or []}, [], 0
                for i, n in enumerate(r["sizes"]):
                    if i in fetched:
                        pieces.append(fetched[i])
                    else:
                        pieces.append(r["ids"][at : at + n * width])
                        at += n * width
                data = b"".join(pieces)
            else:
                data = r["ids"]
            at, leaves = 0, []
            for n in r["sizes"]:
                leaves.append(address(data[at : at + n * width]))
                at += n * width
            if at != len(data) or leaves != r["hashes"] or merkle_root(leaves) != r["root"]:
                raise ValueError(f"document {r['_id']}: its chunks do not give its Merkle root")
            out.append(np.frombuffer(data, dtype).astype("<u4"))
        last = pa.array([zlib.crc32(x.tobytes()) for x in out], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        yield pa.RecordBatch.from_arrays([col("_id"), col("part"), col("start"), col("n_tokens"), last], names=names)


def read_store(spark: SparkSession, path: str, *, wide: bool | None = None, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) for each document, or with ``digest`` ids_crc32 in place of ids.

    The parts' counts and roots are compared with the manifest, and their common root with ``meta``; each chunk is hashed
    again and each document's root compared with its recipe; a difference, or a missing chunk, stops the job. An empty store
    gives an empty result. The bytes of an id are known from the store; ``wide`` only says what is expected.
    """
    small_batches(spark)
    meta = _meta(spark, path)
    if wide is not None and meta.width != (4 if wide else 2):
        raise ValueError(f"{path}: ids have {meta.width} bytes")
    if not verify_manifest(spark, path):
        raise ValueError(f"{path}: the parts are not those of the manifest")
    store, dtype, kind = _read(spark, path), f"<u{meta.width}", meta.id_type
    docs = store.select("kind", "_rid", "_id", "part", "start", "n_tokens", "hashes", "sizes", "shared", "root", "ids")
    last = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    names = ["_id", "part", "start", "n_tokens", last[0]]
    shape = f"_id {kind}, part int, start long, n_tokens long, {last[0]} {last[1]}"
    own = docs.where("kind = 'own'").drop("kind")
    ref = docs.where("kind = 'ref'").drop("kind")
    chunks = store.where("kind = 'chunk'").select(F.col("hashes")[0].alias("hash"), F.col("ids").alias("chunk"))
    wanted = ref.select("_rid", F.explode("shared").alias("place"), "hashes").select("_rid", "place", F.expr("hashes[place]").alias("hash"))
    fetched = wanted.join(chunks, "hash").groupBy("_rid").agg(F.collect_list(F.struct("place", F.col("chunk").alias("ids"))).alias("fetched"))
    assemble = lambda b: _assemble(dtype, names, digest, b)
    out = own.mapInArrow(assemble, shape).unionByName(ref.join(fetched, "_rid", "left").mapInArrow(assemble, shape))
    before = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", "before")
    out = out.join(broadcast_if_small(before), "part")
    return out.select(F.col("_id").alias(id_col), (F.col("start") + F.col("before")).alias("start"), "n_tokens", last[0])


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the parts, made again from the store's documents, are those of the manifest, and their root that of ``meta``."""
    parts, meta = _parts(_read(spark, path)), _meta(spark, path)
    held = sorted(map(tuple, spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()))
    return sorted(parts) == held and _whole(parts) == (meta.n_parts, meta.root)
