"""Local recompression of word sequences: runs and pairs of symbols become named symbols, round by round.

A name is a hash of what it stands for, so all executors give one name to equal content without a shared table. In the
first round, runs of one word become symbols; in each later round, a bit of its name puts every symbol left or right, and
each left symbol that is followed by a right one becomes a pair. Whether two symbols are joined depends on them alone, so
equal word sequences get equal symbols but near their ends. How far the decisions behind a symbol looked is kept with it
(``low``, ``high``): in every sequence that agrees over that span, the symbol stands at the same place.
"""

from __future__ import annotations

import numpy as np

from .words import mix

ROUNDS = 6


def levels(names: np.ndarray, edges: np.ndarray, rounds: int = ROUNDS):
    """(level, name, start, low, high) of the symbols of each level from the highest to the runs; places are inclusive.

    ``low`` and ``high``: first and last word that the symbol's making looked at; one beyond the text where its edge was.
    """
    n, out = len(names), []
    if not n:
        return out
    first = np.zeros(n + 1, bool)
    first[edges] = True
    start = np.flatnonzero(first[:-1] | np.concatenate([[True], names[1:] != names[:-1]]))
    size = np.diff(np.append(start, n))
    # A run's ends show in the words next to it.
    name, low, high = mix(names[start] ^ mix(size.astype(np.uint64))), start - 1, start + size
    out.append((0, name, start, low, high))
    for k in range(1, rounds + 1):
        right = ((mix(name + np.uint64(k)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
        at_first = first[start]  # nothing before it in its text
        at_last = np.append(at_first[1:], True)
        pair = ~right[:-1] & right[1:] & ~at_last[:-1]
        joined = np.append(pair, False)
        second = np.concatenate([[False], pair])
        # An unpaired left symbol looked at the next one, an unpaired right symbol at the one before; at an edge, beyond it.
        before = np.where(at_first, start - 1, np.concatenate([[-1], low[:-1]]))
        end = np.append(start[1:], n) - 1
        after = np.where(at_last, end + 1, np.append(high[1:], n))
        new_low = np.where(joined | ~right, low, np.minimum(low, before))
        new_high = np.where(joined, np.append(high[1:], 0), np.where(right, high, np.maximum(high, after)))
        new_low = np.where(joined, np.minimum(low, np.append(low[1:], n)), new_low)
        new_high = np.where(joined, np.maximum(new_high, high), new_high)
        new_name = np.where(joined, mix(name * np.uint64(3) + mix(np.append(name[1:], np.uint64(0)) + np.uint64(k))), name)
        keep = ~second
        name, start, low, high = new_name[keep], start[keep], new_low[keep], new_high[keep]
        out.append((k, name, start, low, high))
    return out[::-1]
