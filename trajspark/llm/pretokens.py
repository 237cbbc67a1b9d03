"""Exact memo of byte-level BPE pretokens, looked up for whole batches of texts at once.

The tokenizer's pretokenizer (letters, digits, other signs, each with one space before it; white space; English contractions)
is expressed over arrays of byte classes, so a batch of texts is cut into pretokens without a loop in Python. A pretoken of up to
16 bytes is its own key, two 64-bit numbers, in an open-addressing table; longer ones are kept in a dictionary. No hash stands
for a pretoken: keys are compared whole. What is not known yet is asked from the library, once.

Only ASCII, Latin letters up to U+023F and the dashes and quotes U+2010 to U+2026 are classified here. A text with any
other character, or with a special token, is left to the library as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import mix

SEPARATOR, LETTER, DIGIT, SPACE, OTHER, UNKNOWN = range(6)
_CLASS = np.full(256, UNKNOWN, np.uint8)
_CLASS[0] = SEPARATOR
_CLASS[33:127] = OTHER
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[*range(9, 14), 32]] = SPACE
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
PAD = b"\0" * 24


def classes(buf: np.ndarray) -> np.ndarray:
    """A class for each byte of texts joined by zero bytes; UNKNOWN where a character is not classified here."""
    c = _CLASS[buf]
    at = np.flatnonzero(buf == 0xC3)
    sign = at[(buf[at + 1] == 0x97) | (buf[at + 1] == 0xB7)]  # the signs for times and divided by
    c[sign] = c[sign + 1] = OTHER
    at = np.flatnonzero(buf == 0xE2)
    mark = at[(buf[at + 1] == 0x80) & (buf[at + 2] >= 0x90) & (buf[at + 2] <= 0xA6)]
    c[mark] = c[mark + 1] = c[mark + 2] = OTHER
    return c


def boundaries(buf: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether a pretoken (or a run of separators) starts at each byte."""
    start = np.empty(len(buf), bool)
    start[0] = True
    np.not_equal(c[1:], c[:-1], out=start[1:])
    # The last sign of white space before text stands alone, or goes with the text if it is a space.
    last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & (c[1:] != SEPARATOR))
    start[last] = True
    start[last[buf[last] == 32] + 1] = False
    quote = np.flatnonzero((buf == 39) & start)
    quote = quote[c[quote + 1] == LETTER]
    if len(quote):
        x, y = buf[quote + 1], buf[quote + 2]
        size = np.where(np.isin(x, np.frombuffer(b"stmd", np.uint8)), 1, np.where(((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108), 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        behind = quote + 1 + size
        start[behind[c[behind] == LETTER]] = True
    return start


class PretokenTable:
    """Ids of pretokens; forgets all it knows when it holds ``limit`` of them, so its memory is bounded."""

    def __init__(self, ask: Callable[[list[bytes]], list[np.ndarray]], *, bits: int = 21, limit: int = 1_200_000):
        self.ask, self.bits, self.limit = ask, bits, min(limit, (1 << bits) * 5 // 8)
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.known = self.used = 0
        self.at, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where it is not known."""
        slot, out = self._slots(low, high), np.full(len(low), -1, np.int64)
        left = np.arange(len(low))
        while len(left):
            e = self.entry[slot]
            hit = (e >= 0) & (self.low[slot] == low) & (self.high[slot] == high)
            out[left[hit]] = e[hit]
            go = (e >= 0) & ~hit
            left, low, high, slot = left[go], low[go], high[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _add(self, tokens: list[bytes]) -> np.ndarray:
        """New entries for tokens that are not known."""
        found = self.ask(tokens)
        count = np.array([len(x) for x in found], np.int32)
        n, total = len(tokens), int(count.sum())
        while self.known + n > len(self.at):
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        new = np.arange(self.known, self.known + n)
        self.at[new], self.count[new] = self.used + np.cumsum(count) - count, count
        self.ids[self.used : self.used + total] = np.concatenate(found) if found else 0
        self.known, self.used = self.known + n, self.used + total
        return new

    def _put(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        slot = self._slots(low, high)
        left = np.arange(len(low))
        while len(left):
            free = self.entry[slot] < 0
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = free[first]
            self.low[slot[take]], self.high[slot[take]], self.entry[slot[take]] = low[left[take]], high[left[take]], entry[left[take]]
            left, slot = left[~take], (slot[~take] + 1) & ((1 << self.bits) - 1)

    def encode(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each text, None for one that holds a character that is not classified here."""
        raw = b"\0".join([*texts, PAD])
        buf, n = np.frombuffer(raw, np.uint8), len(raw) - len(PAD)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        c = classes(buf)
        # A zero byte inside a text would pass for a separator.
        odd = np.unique(np.searchsorted(first, np.flatnonzero(c[:n] == UNKNOWN), "right") - 1)
        zero = np.flatnonzero(buf[:n] == 0)
        inside = np.setdiff1d(zero, first[1:] - 1)
        odd = np.union1d(odd, np.searchsorted(first, inside, "right") - 1) if len(inside) else odd
        edge = np.flatnonzero(boundaries(buf, c))
        end = np.append(edge[1:], len(buf))
        real = c[edge] != SEPARATOR
        start, size = edge[real], (end - edge)[real]
        of = np.searchsorted(start, first)
        if len(odd):
            keep = np.ones(len(start), bool)
            for d in odd.tolist():
                keep[of[d] : of[d + 1]] = False
            start, size = start[keep], size[keep]
            of = np.searchsorted(start, first)
        if self.known + len(start) // 2 > self.limit and self.known > self.limit // 2:
            self.clear()
        entries = self._entries(raw, start, size)
        count = self.count[entries].astype(np.int64)
        behind = np.cumsum(count)
        ids = self.ids[np.repeat(self.at[entries] - behind + count, count) + np.arange(int(behind[-1]) if len(behind) else 0)]
        cut = np.concatenate([[0], behind])[of]
        out: list[np.ndarray | None] = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for d in odd.tolist():
            out[d] = None
        return out

    def _entries(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        entries = np.empty(len(start), np.int64)
        small = size <= 16
        at, n = start[small], size[small]
        low, high = eight[at] & _MASK[np.minimum(n, 8)], eight[np.minimum(at + 8, len(eight) - 1)] & _MASK[np.maximum(n - 8, 0)]
        found = self._find(low, high)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            order = miss[np.lexsort((high[miss], low[miss]))]
            fresh = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            one = order[fresh]
            new = self._add([raw[a : a + k] for a, k in zip(at[one].tolist(), n[one].tolist(), strict=True)])
            self._put(low[one], high[one], new)
            found[order] = new[np.cumsum(fresh) - 1]
        entries[small] = found
        large = np.flatnonzero(~small)
        if len(large):
            tokens = [raw[a : a + k] for a, k in zip(start[large].tolist(), size[large].tolist(), strict=True)]
            new = list(set(tokens).difference(self.long))
            self.long.update(zip(new, self._add(new).tolist(), strict=True))
            entries[large] = np.fromiter(map(self.long.__getitem__, tokens), np.int64, len(tokens))
        return entries
