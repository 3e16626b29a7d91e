"""Words of Arrow text columns as numpy arrays: boundaries and 64-bit hashes without a Python string per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER, _POINT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[list(b".,;:!?")] = True
#: ASCII but its letters and digits.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words (maximal runs without ASCII white space) of the texts of one Arrow array, in order.

    lower: ASCII capitals as small letters. part: a word also ends between an ASCII letter and one of .,;:!?
    gap: a table of the 256 bytes that stand between words, in place of white space.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, part: bool = False, gap: np.ndarray = _SPACE):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        texts = texts.fill_null("")
        _, offs, data = texts.buffers()
        bounds = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        self.bounds = bounds - bounds[0]
        self.data = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = ~gap[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.bounds] = True
        if part:
            edge[1:n] |= _LETTER[raw[:-1]] & _POINT[raw[1:]]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _upto(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of n words; a shorter document gives its whole sequence as one."""
    h = words.hashes()
    size, total = words.count, len(h)
    out_h, out_d = [], []
    if total >= n:
        g = np.zeros(total - n + 1, dtype=np.uint64)
        for k in range(n):
            g = (g ^ h[k : total - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
            g = g ^ (g >> np.uint64(32))
        whole = words.doc[: total - n + 1] == words.doc[n - 1 :]
        out_h.append(mix(g[whole]))
        out_d.append(words.doc[: total - n + 1][whole])
    for d in np.flatnonzero((size > 0) & (size < n)):
        g = np.uint64(size[d])
        with np.errstate(over="ignore"):
            for x in h[words.first[d] : words.first[d + 1]]:
                g = (g ^ x) * np.uint64(0xD6E8FEB86659FD93)
                g = g ^ (g >> np.uint64(32))
        out_h.append(mix(np.array([g], dtype=np.uint64)))
        out_d.append(np.array([d]))
    if not out_h:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    d, g = np.concatenate(out_d), np.concatenate(out_h)
    if len(out_d) > 1:
        order = np.argsort(d, kind="stable")
        d, g = d[order], g[order]
    return d, g


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct n-grams, by document and hash."""
    d, g = grams(words, n)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return d[new], g[new]


def _trimmed() -> None:
    """Give freed memory back to the system: a worker lives on for later stages, whose executor it shares."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of text, so that a task's arrays stay small; a longer text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at, size = 0, 0
        for i, k in enumerate(lengths):
            if size and size + k > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += int(k)
        yield b.slice(at)
    _trimmed()


def _cut(text: bytes, gap: np.ndarray, most: int) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end before a byte of ``gap``, so that no word is parted."""
    data, at = np.frombuffer(text, dtype=np.uint8), 0
    while len(data) - at > most:
        end, step = at + most, 4096
        while end < len(data):
            between = np.flatnonzero(gap[data[end : end + step]])
            if len(between):
                end += int(between[0])
                break
            end, step = min(end + step, len(data)), step * 2
        yield text[at:end]
        at = end
    yield text[at:]


def parted(batches: Iterator[pa.RecordBatch], column: str, gap: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[pa.Array, bool]]]]:
    """Slices of rows as ``pieces`` makes them, each with its texts: all in one array, or, where the slice is one text longer
    than ``most``, its parts one at a time (True: a part of row 0). Arrays over texts then stay small however long a text is."""
    for b in pieces(batches, column, most):
        texts = b.column(column)
        size = pa.compute.binary_length(texts[0]).as_py() if b.num_rows == 1 else 0
        if size and size > most:
            whole = texts[0].as_py().encode("utf-8", "surrogatepass")
            yield b, ((pa.array([p], pa.large_binary()).cast(pa.large_string()), True) for p in _cut(whole, gap, most))
        else:
            yield b, iter([(texts, False)])
