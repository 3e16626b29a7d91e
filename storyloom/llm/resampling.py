"""Importance resampling towards a target: hashed word n-grams, counted and scored by payloads of a word automaton.

Each task keeps an Aho-Corasick automaton over the distinct words it has met, each bounded by delimiters and carrying the
CRC and the length of its bytes. A scan of the texts emits a payload for each word without making the word itself. The CRC
of a run of words follows from the payloads of its words alone, as the CRC of joined strings is linear in the parts'.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import bounded, vector_rows, vector_sum, written
from storyloom.llm.textkernel import NOT_WORD, Words, parted
from storyloom.plans.numbering import numbered

WIDTH = 4096


def _byte_step() -> np.ndarray:
    """The table of the CRC's step over one byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _byte_step()
_zeros: dict[int, np.ndarray] = {0: np.uint32(1) << np.arange(32, dtype=np.uint32)}


def _applied(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map that sends bit i to images[i], of each x."""
    out = np.zeros(len(x), dtype=np.uint32)
    for i in range(32):
        out ^= np.where((x >> np.uint32(i)) & np.uint32(1), images[i], np.uint32(0))
    return out


def _zero_bytes(n: int) -> np.ndarray:
    """The map of a CRC when ``n`` zero bytes follow, by halving."""
    if n not in _zeros:
        half = _zero_bytes(n // 2)
        m = _applied(half, half)
        made = _STEP[m & np.uint32(255)] ^ (m >> np.uint32(8)) if n % 2 else m
        if n > 256:
            return made
        _zeros[n] = made
    return _zeros[n]


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of each left string followed by the right one, of the given length in bytes."""
    out = right.copy()
    for n in np.unique(length).tolist():
        these = np.flatnonzero(length == n)
        out[these] ^= _applied(_zero_bytes(n), left[these])
    return out


class WordPayloads:
    """CRC and length of every word, from an automaton over the distinct words met so far.

    The automaton is made anew whenever the words it lacks are half as many as those it has; beyond ``most_bytes`` it begins
    again with the latest. Words of more than ``longest`` bytes never enter it. Words that it lacks get their CRC directly.
    """

    def __init__(self, most_bytes: int = 4_000_000, longest: int = 64):
        self.most, self.longest = most_bytes, longest
        self.words: list[bytes] = []
        self.size = 0
        self._renewed({})

    def _renewed(self, pending: dict[bytes, int]) -> None:
        import ahocorasick

        more = sum(map(len, pending))
        if self.size + more > self.most:
            self.words, self.size = [], 0
        self.words += pending
        self.size += more
        self.pending: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(self.words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        if self.words:
            self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in self.words], dtype=np.uint32)

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        length = w.end - w.start
        crc, known = np.zeros(len(length), dtype=np.uint32), np.zeros(len(length), dtype=bool)
        if self.words and len(length):
            # one blank for each byte between words, and one before, between and after the texts; a character is a byte
            text = np.insert(np.where(NOT_WORD[w.data], np.uint8(0x20), w.data), w.bounds, np.uint8(0x20)).tobytes().decode("latin-1")
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64)
            at = np.searchsorted(w.end + w.doc + 1, found[0::2])
            crc[at], known[at] = self.crc[found[1::2]], True
        for i in np.flatnonzero(~known).tolist():
            word = w.word(i)
            x = self.pending.get(word)
            if x is None:
                x = zlib.crc32(word)
                if len(word) <= self.longest:
                    self.pending[word] = x
            crc[i] = x
        if len(self.pending) > max(1000, len(self.words) // 2):
            self._renewed(self.pending)
        return crc, length


def _features(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each slice of rows, in parts: the row of each feature, its bucket, and the number of words of each row."""
    payloads = WordPayloads()

    def of(b: pa.RecordBatch, texts: Iterator[tuple[pa.Array, bool]]):
        crc, length, row = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for t, part in texts:
            w = Words(t, lower=True, gap=NOT_WORD)
            kept = min(n - 1, len(crc)) if part else 0  # the words before, for runs that began there
            new_crc, new_length = payloads(w)
            crc, length, row = np.concatenate([crc[len(crc) - kept :], new_crc]), np.concatenate([length[len(length) - kept :], new_length]), np.concatenate([row[len(row) - kept :], w.doc])
            run, made = crc, [(row[kept:], crc[kept:])]
            for k in range(1, min(n, len(row))):
                left, blank = run[: len(row) - k], np.full(len(row) - k, zlib.crc32(b" "), dtype=np.uint32)
                run = joined_crc(joined_crc(left, blank, np.ones(len(left), dtype=np.int64)), crc[k:], length[k:])
                use = (row[k:] == row[: len(row) - k]) & (np.arange(k, len(row)) >= kept)
                made.append((row[k:][use], run[use]))
            yield np.concatenate([r for r, _ in made]), np.concatenate([c for _, c in made]) % np.uint32(buckets), np.bincount(w.doc, minlength=b.num_rows)

    for b, texts in parted(batches, "text", NOT_WORD):
        yield b, of(b, texts)


def bucket_counts(texts: DataFrame, buckets: int, n: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    size = -(-buckets // WIDTH) * WIDTH

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for _, parts in _features(batches, n, buckets):
            for _, bucket, _ in parts:
                total += np.bincount(bucket, minlength=size)
        yield from vector_rows(total, WIDTH)

    bounded(texts.sparkSession)
    return vector_sum(texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "slot int, kind string, places binary, counts binary"), size, WIDTH)[:buckets]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source, one added to each count."""
    k, all_s, all_t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + k) / ((s + 1.0) * (all_t + k)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10000, num: int = 10, den: int = 100, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document.

    Features are runs of 1 to ``n`` words; a word is a run of ASCII letters and digits and of what is not ASCII, capitals A-Z
    as small letters. A document's weight is the mean gain of its features, floored; its score adds Gumbel noise, in
    thousandths, that follows from ``seed`` and doc_id alone, so the num / den highest of the documents with ``least_words``
    words or more are a sample without replacement in proportion to exp(weight / 1000). Ranks go by score and then doc_id.

    Null and empty texts have no features, weight 0, and are never drawn if ``least_words`` is above 0; a null doc_id is read
    as no characters and comes last among equal scores; rows that repeat are drawn each by itself; an empty target or an
    empty table of documents is allowed. Only counts, one for each bucket, meet on the driver; ranks come from sorted ranges.
    """
    value = gains(bucket_counts(docs, buckets, n, text_col), bucket_counts(target, buckets, n, target_col))
    sent = docs.sparkSession.sparkContext.broadcast(value)

    def weigh(batches):
        for b, parts in _features(batches, n, buckets):
            total, size, words = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for row, bucket, count in parts:
                np.add.at(total, row, sent.value[bucket])
                size += np.bincount(row, minlength=b.num_rows)
                words += count
            weight = np.where(size > 0, total // np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, weight, words))], names=["doc_id", "n_features", "weight", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_features long, weight long, words long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("words") >= least_words).alias("able")))
    drawn = scored.where("able").count() * num // den
    placed = numbered(scored, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")], name="place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
