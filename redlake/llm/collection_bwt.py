"""Column-wise construction of a collection's BWT and common prefixes.

All strings are read from their ends, one symbol of each a round. The suffixes found so far
stand in order; BWT and LCP are two sequences over that order. A round finds, for each
string, where its next longer suffix belongs (its symbol's rank in the BWT, below the
string's last place), and copies both sequences once, in order, with the new entries put in.
With a folder, the sequences stand in files there between rounds: a round reads those of the
last one from end to end and writes its own.
"""

from __future__ import annotations

import os

import numpy as np

END = 0


#: A key is a symbol and, in its low half, the row that it stands in.
_ROW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int = 16) -> np.ndarray:
    """The least of values[lo..hi] of each pair lo <= hi: of the ends within their blocks, and of doubling ranges of whole blocks between."""
    n = -(-len(values) // block)
    blocks = np.full(n * block, 255, dtype=np.uint8)
    blocks[: len(values)] = values
    blocks = blocks.reshape(n, block)
    p, q = lo // block, hi // block
    at = np.arange(block)
    low, high = at >= (lo % block)[:, None], at <= (hi % block)[:, None]
    same = (p == q)[:, None]
    left = np.where(low & (high | ~same), blocks[p], np.uint8(255))
    right = np.where(high & (low | ~same), blocks[q], np.uint8(255))
    out = np.minimum(left, right).min(axis=1)
    between = q - p - 1
    level, width = blocks.min(axis=1), 1
    while width <= between.max(initial=0):
        some = np.flatnonzero((between >= width) & (between < 2 * width))
        out[some] = np.minimum(out[some], np.minimum(level[p[some] + 1], level[q[some] - width]))
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return out


def _shared(lcp: np.ndarray, keys: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Common prefix of new rows `at` and those before them: none, or one symbol and what their rests share."""
    out = np.zeros(len(at), dtype=np.uint8)
    k = at - m
    inner = np.flatnonzero((k > 0) & (k < len(keys)))
    a, b = keys[k[inner] - 1], keys[k[inner]]
    same = a >> _HIGH == b >> _HIGH
    inner, a, b = inner[same], (a[same] & _ROW).astype(np.int64), (b[same] & _ROW).astype(np.int64)
    if len(inner):
        out[inner] = np.minimum(least_between(lcp, a + 1, b), 253) + 1
    return out


class _Sequences:
    """BWT and LCP as they stand after a round: two files that the next round reads, or two arrays."""

    def __init__(self, bwt: np.ndarray, lcp: np.ndarray, folder: str | None):
        self.folder, self.types, self.round = folder, (bwt.dtype, lcp.dtype), 0
        self.put(bwt, lcp)

    def _names(self, number: int) -> list[str]:
        return [os.path.join(self.folder, f"{kind}-{number}") for kind in ("bwt", "lcp")]

    def put(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.held = (bwt, lcp)
        if self.folder:
            self.drop()
            self.round += 1
            self.held = None
            for name, x in zip(self._names(self.round), (bwt, lcp), strict=True):
                x.tofile(name)

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        return self.held or tuple(np.fromfile(name, dtype=t) for name, t in zip(self._names(self.round), self.types, strict=True))

    def drop(self) -> None:
        if self.folder and self.round:
            for name in self._names(self.round):
                os.remove(name)


def suffixes_shared(strings: list[np.ndarray], depth: int, folder: str | None = None) -> list[np.ndarray]:
    """For each string, whether the suffix at each place shares its first `depth` symbols (at most 254) with another suffix.

    Symbols are numbers above END, in any order, and a suffix ends with its string. One entry
    per place at which `depth` symbols are left. The rows of each symbol are kept in order
    beside the BWT, so that a rank is a search.
    """
    m = len(strings)
    n = np.array([len(s) for s in strings], dtype=np.int64)
    longest = int(n.max(initial=0))
    if not m or longest < depth:
        return [np.zeros(max(0, x - depth + 1), dtype=bool) for x in n]
    # Column j has symbol j from the end, END where a string has none.
    columns = np.zeros((longest + 1, m), dtype=strings[0].dtype)
    for i, s in enumerate(strings):
        columns[: len(s), i] = s[::-1]
    kept = _Sequences(columns[0].copy(), np.zeros(m, dtype=np.uint8), folder)
    live, row = np.arange(m), np.arange(m)  # each live string's latest suffix
    keys = np.zeros(0, dtype=np.uint64)
    for j in range(1, longest + 1):
        bwt, lcp = kept.get()
        symbols = bwt[row]
        going = symbols != END
        live, row, symbols = live[going], row[going], symbols[going]
        if not len(live):
            break
        # The latest symbols join the others in order; where they come is their rank.
        latest = symbols.astype(np.uint64) << _HIGH | row.astype(np.uint64)
        by = np.argsort(latest)
        live, latest = live[by], latest[by]
        place = np.searchsorted(keys, latest)
        keys = np.insert(keys, place, latest)
        new = place + np.arange(m, m + len(live))
        size = len(bwt) + len(new)
        after = new + 1
        shared, shared_after = np.split(_shared(lcp, keys, np.concatenate([new, after]), m), 2)
        old = np.ones(size, dtype=bool)
        old[new] = False
        moved = np.flatnonzero(old)
        both, next_lcp = np.empty(size, dtype=bwt.dtype), np.empty(size, dtype=np.uint8)
        both[moved], both[new] = bwt, columns[j, live]
        next_lcp[moved] = lcp
        inside = after < size
        next_lcp[after[inside]] = shared_after[inside]
        next_lcp[new] = shared
        rows = keys.view("<u4")[::2]
        rows[:] = moved[rows]
        kept.put(both, next_lcp)
        row = new
    bwt, lcp = kept.get()
    kept.drop()
    # From the empty suffixes, each step along the BWT leads to the suffix longer by one.
    deep = np.append(lcp >= depth, False)
    deep = deep[:-1] | deep[1:]
    step = np.empty(len(bwt), dtype=np.int64)
    step[(keys & _ROW).astype(np.int64)] = np.arange(len(keys)) + m
    found = [np.zeros(max(0, x - depth + 1), dtype=bool) for x in n]
    marks = np.zeros((longest + 1, m), dtype=bool)
    who, at = np.arange(m), np.arange(m)
    for j in range(longest + 1):
        marks[j, who] = deep[at]
        going = bwt[at] != END
        who, at = who[going], step[at[going]]
        if not len(who):
            break
    for i, x in enumerate(n):
        if x >= depth:
            found[i] = marks[depth : x + 1, i][::-1].copy()
    return found
