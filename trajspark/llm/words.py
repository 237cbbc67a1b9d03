"""Word sequences as arrays of hashes: names of words, hashes of windows, edges of documents in a batch."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Names of longer words are remembered, up to so many.
_LONG_WORDS = 100_000
_long: dict[bytes, tuple[int, int]] = {}


def _long_name(word: bytes) -> tuple[int, int]:
    found = _long.get(word)
    if found is None:
        if len(_long) >= _LONG_WORDS:
            _long.clear()
        d = blake2b(word, digest_size=16, key=b"trajspark words").digest()
        found = _long[word] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")
    return found


def word_names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit names of each word ``[^\\x20\\x09-\\x0D]+``, all words in a row; and where each text's names begin, and the last one's end.

    A name is the same in every process. The two are made independently of each other: for words of up to 16 bytes from all
    their bytes and their length, by bijections of 64-bit numbers; for longer ones from a keyed BLAKE2b digest of 128 bits.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join([*data, b" " * 17])
    buf = np.frombuffer(raw, np.uint8)
    space = _SPACE[buf]
    start = np.flatnonzero(~space & np.insert(space[:-1], 0, True))
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    first = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])]).astype(np.int64)
    edges = np.searchsorted(start, first)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), edges
    eight, size = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)), end - start
    low, high = eight[start] & _MASK[np.minimum(size, 8)], eight[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
    n = size.astype(np.uint64)
    one = mix(low ^ mix(high + mix(n)))
    two = mix(high ^ mix(low + mix(n + np.uint64(1 << 32))))
    for i in np.flatnonzero(size > 16).tolist():
        one[i], two[i] = _long_name(raw[start[i] : end[i]])
    return one, two, edges


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 2**64)
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (base, inverse))


def window_hashes(names: np.ndarray, size: int, base: int) -> np.ndarray:
    """For each place a hash of the ``size`` names from there: a polynomial modulo 2**64, mixed. Windows may span texts.

    Such polynomials have known collisions between sequences of two values from some 1,000 terms on; windows are held well below.
    """
    if size > 512:
        raise ValueError("windows of more than 512 words need another hash")
    n = len(names)
    if n < size:
        return np.empty(0, np.uint64)
    length = 1 << max(12, int(n).bit_length())
    up, down = _powers(base, length)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(names + np.uint64(base)) * up[:n])])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


#: Two odd bases; a window's identity is 128 bits: a hash of its words' first names by one, and of their second names by the other.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def text_of(places: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of the text that holds each place."""
    return np.searchsorted(edges, places, "right") - 1
