"""Alike lines by the postings of their shingles, in numpy: what tests hold the line dedup's DataFrame form against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from storyloom.llm.textkernel import mix

SHINGLE = 8
#: Groups of at most so many lines are compared many at a time.
SMALL = 16
#: Counters and posting visits that one step of a comparison holds.
STEP = 2_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _chars(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all lines as numbers, one after another, and each line's number of characters. A character is its
    UTF-8 bytes, so bytes that are not UTF-8 are compared too."""
    lines = lines.cast(pa.large_binary())
    _, offs, data = lines.buffers()
    bounds = np.frombuffer(offs, dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    if not (raw & 0x80).any():
        return raw.astype(np.uint64), np.diff(bounds)
    first = (raw & 0xC0) != 0x80
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(first)
    width = np.diff(at, append=len(raw))
    wide = np.concatenate([raw, np.zeros(3, dtype=np.uint8)]).astype(np.uint64)
    values = wide[at]
    for k in range(1, 4):
        values |= np.where(width > k, wide[at + k], np.uint64(0)) << np.uint64(8 * k)
    return values, np.diff(np.searchsorted(at, bounds))


def _shingles(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of all lines, line by line, and each line's number of them. A line shorter than a
    shingle is filled up with a sign that no character has, so it is its own only one."""
    values, size = _chars(lines)
    padded = np.maximum(size, SHINGLE)
    starts = np.cumsum(padded) - padded
    if (size < SHINGLE).any():
        filled = np.full(int(padded.sum()), 1 << 40, dtype=np.uint64)
        filled[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(values))] = values
        values = filled
    h = np.zeros(max(0, len(values) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        h *= _FACTOR
        h += values[k : len(values) - SHINGLE + 1 + k]
    n = padded - SHINGLE + 1
    inner = np.ones(len(h), dtype=bool)
    cut = (starts[1:, None] - np.arange(1, SHINGLE)).ravel()
    inner[cut] = False
    return mix(h[inner]), n


class _Postings:
    """The postings of the shingles of lines, group by group; ``first`` is the first line of each line's group.

    A posting is the high bits of a shingle's hash with its group, and the line in the low bits: one sort makes the sets
    and the postings.
    """

    def __init__(self, h: np.ndarray, n: np.ndarray, first: np.ndarray):
        total = len(n)
        low = np.uint64(int(total).bit_length())
        line = np.repeat(np.arange(total), n)
        posted = mix(h + first[line].astype(np.uint64) * _FACTOR) >> low << low | line.astype(np.uint64)
        posted.sort()
        posted = posted[np.concatenate([[True], posted[1:] != posted[:-1]])]
        self.line = (posted & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        self.size = np.bincount(self.line, minlength=total)
        new = np.flatnonzero(np.concatenate([[True], posted[1:] >> low != posted[:-1] >> low]))
        runs = np.diff(new, append=len(posted))
        start, run = np.repeat(new, runs), np.repeat(runs, runs)
        self.width = int(np.bincount(first, minlength=total).max())
        # shingles that an eighth of a large group has are counted by one matrix product
        often = run * 8 >= self.width if total == self.width > SMALL else np.zeros(len(run), dtype=bool)
        self.grid = np.zeros((total, len(np.unique(start[often]))), dtype=np.float32)
        self.grid[self.line[often], np.unique(start[often], return_inverse=True)[1]] = 1
        use = np.flatnonzero((run > 1) & ~often)
        use = use[np.argsort(self.line[use], kind="stable")]
        self.start, self.run, self.first = start[use], run[use], first
        self.rows = np.searchsorted(self.line[use], np.arange(total + 1))
        self.cost = np.diff(np.concatenate([[0], np.cumsum(self.run)])[self.rows])

    def alike(self, asked: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y) of an asked line x and another of its group whose sets are similar enough, a step at a time."""
        weight = self.cost[asked] + self.width
        steps = np.cumsum(weight) // STEP
        for part in np.split(asked, np.flatnonzero(np.diff(steps)) + 1):
            k = self.rows[part + 1] - self.rows[part]
            at = np.repeat(self.rows[part] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            s, r = self.start[at], self.run[at]
            i = np.repeat(np.repeat(np.arange(len(part)), k), r)
            y = self.line[np.repeat(s - (np.cumsum(r) - r), r) + np.arange(int(r.sum()))]
            first = self.first[part]
            inside = self.first[y] == first[i]
            i, y = i[inside], y[inside]
            same = np.bincount(i * self.width + y - first[i], minlength=len(part) * self.width)
            if self.grid.shape[1]:
                same += (self.grid[part] @ self.grid.T).astype(np.int64).ravel()
            at = np.flatnonzero(same)
            i, same = at // self.width, same[at]
            x, y = part[i], at % self.width + first[i]
            good = (same * den >= (self.size[x] + self.size[y] - same) * num) & (x != y)
            yield x[good], y[good]
