"""BPE encoding and decoding with reuse of content-defined chunks.

A text's bytes are cut where a rolling hash of the last 32 bytes ends in zeros, so equal passages of different documents
give equal chunks wherever they stand. A process encodes each chunk that it knows once and keeps it, with those still in use,
in a bounded cache. A cut can fall inside a pretoken, so each join is repaired: a window around it, between two places where
any scan must end a pretoken, is encoded anew, and its ids have to agree with both chunks' own on either side; where they
don't, the document is encoded whole. The result equals the library's for the whole text.

Chunks are shared among the documents that one process reads. Sharing them across the cluster would shuffle all texts for a
few per cent of repeated ones; see the README.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import PretokenTable
from .shared_places import by_size

WINDOW = 32
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
#: Bytes of texts that are cut into pretokens at once; one longer text is worked on by itself.
BYTES = 1 << 20
#: Bytes on each side of a join that are searched for places where it can be repaired.
REACH = 400


def rolling_hash(gear: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 values at each place (fewer at the start): sum of gear << age, modulo 2**32."""
    h, width = gear, 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
        width *= 2
    return h


def cut_places(gear: np.ndarray, mean: int) -> np.ndarray:
    """Places after which the rolling hash cuts: it is small once in ``mean`` places. ``gear``: a mixed uint32 for each value."""
    if len(gear) <= WINDOW:
        return np.empty(0, np.int64)
    # The upper bits of a gear hash depend on all 32 values.
    places = np.flatnonzero(rolling_hash(gear) < np.uint32(2**32 // mean)) + 1
    return places[(places >= WINDOW) & (places < len(gear))]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A tokenizer file with exact memos. Byte-level BPE without normalizer or post-processor only."""

    def __init__(self, path: str, *, memo: int = 1_200_000, chunk: int = 2048, chunks: int = 6_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(path).to_str())
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or spec["post_processor"] or spec["model"]["dropout"]:
            raise ValueError("byte-level BPE without normalizer, prefix space, dropout or post-processor only")
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.chunk, self.chunks = chunk, chunks
        byte_of = _byte_of()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        n = 1 + max([*spec["model"]["vocab"].values(), *added])
        self.piece = [b""] * n
        for s, i in spec["model"]["vocab"].items():
            self.piece[i] = added.get(i) or b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode() for c in s)
        for i, s in added.items():
            self.piece[i] = s
        self.size = np.array([len(p) for p in self.piece], np.int64)
        self.pretokens = PretokenTable(self._ask_pretokens, limit=memo)
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # ids, and where each ends in the chunk
        self.older: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # the generation before: what is still in use moves on from it

    def _ask_pretokens(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of each pretoken. Those that begin with a space are asked for many at a time and told apart by the ids' byte lengths."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(tokens)
        spaced = [i for i, t in enumerate(tokens) if t[0] == 32 and t[-1] > 32]
        lone = [i for i, t in enumerate(tokens) if not (t[0] == 32 and t[-1] > 32)]
        groups = [spaced[i : i + 256] for i in range(0, len(spaced), 256)]
        for group, e in zip(groups, self.lib.encode_batch_fast([b"".join([tokens[i] for i in g]).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum([len(tokens[i]) for i in group])
            cut = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
            for i, a, b in zip(group, [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                out[i] = ids[a:b]
        for i, e in zip(lone, self.lib.encode_batch_fast([tokens[i].decode() for i in lone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them; pretokens that were seen before are not asked for again."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, d in enumerate(data) if not any(s in d for s in self.special)]
        for part in by_size([data[i] for i in plain], BYTES):
            for i, ids in zip(plain[part], self.pretokens.encode([data[i] for i in plain[part]]), strict=True):
                out[i] = ids
        slow = [i for i, o in enumerate(out) if o is None]
        for i, e in zip(slow, self.lib.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def encode_chunked(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, from chunks that are encoded once and joins that are repaired."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        parts = [self._chunks(b) for b in data]
        if len(self.known) > self.chunks:
            self.known, self.older = {}, self.known
        new = {c for p in parts for c in p}.difference(self.known)
        self.known.update([(c, self.older[c]) for c in new if c in self.older])
        new = list(new.difference(self.known))
        self.known.update((c, (ids, np.cumsum(self.size[ids]))) for c, ids in zip(new, self.encode([c.decode() for c in new]), strict=True))
        windows = [_join_windows(p) for p in parts]
        again = iter(self.encode([b[w[0] : w[3]].decode() for b, ws in zip(data, windows, strict=True) for w in ws or ()]))
        out = [self._joined(p, ws, [next(again) for _ in ws or ()]) for p, ws in zip(parts, windows, strict=True)]
        whole = [i for i, o in enumerate(out) if o is None]
        for i, ids in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _chunks(self, data: bytes) -> list[bytes]:
        if any(s in data for s in self.special):
            return [data]  # a special token in the text splits it before any pretoken does
        view = np.frombuffer(data, np.uint8)
        at = cut_places(_GEAR[view], self.chunk)
        at = at[(view[at] & 0xC0) != 0x80]  # between characters
        edges = [0, *at.tolist(), len(data)]
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _joined(self, parts: list[bytes], windows: list[tuple[int, int, int, int]] | None, again: list[np.ndarray]) -> np.ndarray | None:
        """Ids of the whole: each chunk's own between the joins, and of each join's window what lies between its inner places.

        None if the window's ids don't agree with the chunks' own on both sides of the join.
        """
        if windows is None:
            return None
        if len(parts) == 1:
            return self.known[parts[0]][0]
        out, at, low = [], 0, 0
        for part, right, (a, s, e, z), ids in zip(parts[:-1], parts[1:], windows, again, strict=True):
            (left_ids, left_ends), (right_ids, right_ends) = self.known[part], self.known[right]
            behind = at + len(part)
            i, j = np.searchsorted(left_ends, (a - at, s - at)).tolist()
            k, m = np.searchsorted(right_ends, (e - behind, z - behind)).tolist()
            x, y = j - i, m - k
            if left_ends[i] != a - at or left_ends[j] != s - at or right_ends[k] != e - behind or right_ends[m] != z - behind or len(ids) < x + y:
                return None
            if not (np.array_equal(ids[:x], left_ids[i + 1 : j + 1]) and np.array_equal(ids[len(ids) - y :], right_ids[k + 1 : m + 1])):
                return None
            out += [left_ids[low : j + 1], ids[x : len(ids) - y]]
            at, low = behind, k + 1
        out.append(self.known[parts[-1]][0][low:])
        return np.concatenate(out)


def _ends_letters(data: bytes, p: int) -> bool:
    """Between an ASCII letter and an ASCII non-letter: a run of letters ends here in any scan of the text."""
    a, b = data[p - 1] | 32, data[p]
    return 97 <= a <= 122 and b < 128 and not 97 <= b | 32 <= 122


def _join_windows(parts: list[bytes]) -> list[tuple[int, int, int, int]] | None:
    """For each join two places before it and two behind, all where a run of letters ends; None if there are none within reach or windows meet."""
    out, at, free = [], 0, 0
    for left, right in zip(parts[:-1], parts[1:], strict=True):
        found = []
        for p in range(len(left) - 1, max(0, len(left) - REACH), -1):
            if _ends_letters(left, p):
                found.append(at + p)
                if len(found) == 2:
                    break
        at += len(left)
        for p in range(1, min(len(right), REACH)):
            if _ends_letters(right, p):
                found.append(at + p)
                if len(found) == 4:
                    break
        if len(found) < 4 or found[0] < at - len(left) or found[1] < free or not found[1] < found[0] < at < found[2]:
            return None
        out.append((found[1], found[0], found[2], found[3]))
        free = found[3]
    return out


def _digest(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = code.encode_chunked(texts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(code.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()),
            ],
            names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _encode(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    for batch in batches:
        ids = code.encode_chunked([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=[batch.schema.names[0], "ids"])


def _decode(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    for batch in batches:
        texts = [code.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[batch.schema.names[0], "text"])


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row; a null or empty text has no ids. Other columns of ``docs`` are not read."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda b: _encode(path, b), f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row; null ids decode to an empty text."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(lambda b: _decode(path, b), f"`{id_col}` {kind}, text string")


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text is encoded and decoded again in one pass, without a shuffle.

    Null texts count as empty; repeated rows and null ids give one row each; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda b: _digest(path, b), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
