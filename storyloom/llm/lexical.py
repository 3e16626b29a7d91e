"""Ranked lexical search by bit-sliced Bloom signatures, which bound every document's score, and exact rescoring.

A document's signature holds a key for each of its distinct terms at each level of term frequency that it reaches. Blocks
of documents of like size store one bitmap over their documents for each bit position (a slice), so that a query key is
an AND of a few short bitmaps for a whole block. Bloom filters err on one side: a term may seem present, or more frequent,
but never absent. Sums of the slices weighted by the terms are thus upper bounds of scores, and only documents whose
bound is below what the k best of some exactly scored ones reach are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.shared import bounded, removed, vector_rows, vector_sum, written
from storyloom.llm.textkernel import NOT_WORD, Words, mix, parted

WIDTH = 4096
#: Term frequencies at which a level begins. A term at a level but not at the next occurs less often than the next begins.
LEVELS = (1, 2, 3, 4, 6, 9, 17, 65, 1025)
HASHES = 3
BLOCK = 1024
#: The most bits of a block, and the most bit positions of a document.
BLOCK_BITS, POSITIONS = 1 << 24, 1 << 24
#: Terms whose bitmaps are summed at once.
STEP = 2048
INDEX = "slices int, size int, doc_id binary, known binary, row binary, n binary, bits binary"


def _level_keys(term: np.ndarray, level: int) -> np.ndarray:
    return mix(term + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1)))


def _positions(keys: np.ndarray, slices: int) -> np.ndarray:
    """The HASHES slices of each key, a power of two of them in all."""
    a, b = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
    return np.stack([(a + np.uint64(i) * (b | np.uint64(1))) & np.uint64(slices - 1) for i in range(HASHES)]).astype(np.int64)


def _counted(texts: Iterator[tuple[pa.Array, bool]], rows: int, of=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, by row, and each row's number of words. ``of``: from Words to
    the number of each word's term and whether it is one; by default, hashes."""
    row, term, count, size = [], [], [], np.zeros(rows, dtype=np.int64)
    for t, _ in texts:
        w = Words(t, lower=True, gap=NOT_WORD)
        size += np.bincount(w.doc, minlength=rows)
        if of is None:
            d, h = w.doc, w.hashes()
        else:
            at = of(w)
            d, h = w.doc[at >= 0], at[at >= 0].astype(np.uint64)
        d, h, c = _summed(d, h, np.ones(len(d), dtype=np.int64))
        row.append(d)
        term.append(h)
        count.append(c)
    if len(row) == 1:
        return row[0], term[0], count[0], size
    return *_summed(np.concatenate(row), np.concatenate(term), np.concatenate(count)), size


def _summed(row: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    row, term, count = row[order], term[order], count[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return row[first], term[first], np.add.reduceat(count, first) if len(first) else count


class _Blocks:
    """Documents of like size, gathered until they fill a block."""

    def __init__(self):
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc_id: int | None, row: int, n: int, keys: np.ndarray) -> Iterator[tuple]:
        slices = min(POSITIONS, 1 << max(6, int(len(keys) * 8 - 1).bit_length()))
        group = self.open.setdefault(slices, [])
        group.append((doc_id, row, n, keys))
        if len(group) >= max(8, min(BLOCK, BLOCK_BITS // slices)):
            yield self._made(slices)

    def rest(self) -> Iterator[tuple]:
        for slices in list(self.open):
            yield self._made(slices)

    def _made(self, slices: int) -> tuple:
        group = self.open.pop(slices)
        wide = -(-len(group) // 8)
        bits = np.zeros(slices * wide, dtype=np.uint8)
        at = np.repeat(np.arange(len(group)), [len(g[3]) for g in group])
        for p in _positions(np.concatenate([g[3] for g in group]), slices):
            np.bitwise_or.at(bits, p * wide + at // 8, (np.uint8(128) >> (at % 8).astype(np.uint8)))
        ids = np.array([g[0] or 0 for g in group], dtype="<i8"), np.array([g[0] is not None for g in group]), np.array([g[1] for g in group], dtype="<i8"), np.array([g[2] for g in group], dtype="<i8")
        return (slices, len(group), *(x.tobytes() for x in ids), bits.tobytes())


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["slices", "size", "doc_id", "known", "row", "n", "bits"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and a row key of both, which rows that repeat share."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def signatures(docs: DataFrame) -> DataFrame:
    """The index: blocks of bit slices over all documents with a term (``keyed`` rows). It knows no query."""
    bounded(docs.sparkSession)

    def build(batches):
        blocks, out, size = _Blocks(), [], 0
        for b, texts in parted(batches, "text", NOT_WORD):
            row, term, count, n = _counted(texts, b.num_rows)
            ids, keys = b.column("doc_id").to_pylist(), b.column("row").to_pylist()
            levels = [(row[here := count >= start], _level_keys(term[here], k)) for k, start in enumerate(LEVELS)]
            rows = np.concatenate([r for r, _ in levels])
            order = np.argsort(rows, kind="stable")
            rows, all_keys = rows[order], np.concatenate([k for _, k in levels])[order]
            cut = np.searchsorted(rows, np.arange(b.num_rows + 1))
            for i in np.flatnonzero(n).tolist():
                for made in blocks.add(ids[i], keys[i], int(n[i]), all_keys[cut[i] : cut[i + 1]].copy()):
                    out.append(made)
                    size += len(made[-1])
            if size > 4_000_000:
                yield _index_batch(out)
                out, size = [], 0
        out += blocks.rest()
        if out:
            yield _index_batch(out)

    return docs.mapInArrow(build, INDEX)


class Vocabulary:
    """The terms of the queries: their words, and which term each word of a text is, by bytes and not by hash alone."""

    def __init__(self, words: list[bytes]):
        w = Words(pa.array([b" ".join(words).decode()], pa.string()), gap=NOT_WORD)
        h = w.hashes()
        order = np.argsort(h, kind="stable")
        self.words = [words[i] for i in order.tolist()]
        self.hash = h[order]
        self.at = {x: i for i, x in enumerate(self.words)}
        self.length = np.array([len(x) for x in self.words], dtype=np.int64)
        self.head, self.tail = ([int.from_bytes(x[a:b].ljust(8, b"\0"), "little") for x in self.words] for a, b in ((0, 8), (-8, None)))
        self.head, self.tail = np.array(self.head, dtype=np.uint64), np.array(self.tail, dtype=np.uint64)
        twin = np.zeros(len(h), dtype=bool)
        twin[1:] |= self.hash[1:] == self.hash[:-1]
        twin[:-1] |= self.hash[1:] == self.hash[:-1]
        self.slow = (self.length > 16) | twin  # where the first and last eight bytes do not settle it
        bits = min(24, max(16, len(words).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.mark = np.zeros(1 << bits, dtype=bool)
        self.mark[(self.hash >> self.shift).astype(np.int64)] = True

    def places(self, w: Words) -> np.ndarray:
        """The place of each word's term, or -1."""
        h = w.hashes()
        out = np.full(len(h), -1, dtype=np.int64)
        some = np.flatnonzero(self.mark[(h >> self.shift).astype(np.int64)])
        k = np.searchsorted(self.hash, h[some])
        same = k < len(self.hash)
        same[same] = self.hash[k[same]] == h[some[same]]
        some, k = some[same], k[same]
        length = w.end[some] - w.start[some]
        data = np.concatenate([np.zeros(8, dtype=np.uint8), w.data, np.zeros(8, dtype=np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        keep = np.minimum(length, 8)
        mask = (np.arange(8) < keep[:, None]).astype(np.uint8)
        head = (eight[w.start[some] + 8] * mask).view("<u8")[:, 0]
        # the last eight bytes of a word; a shorter word is settled by its first
        good = (length == self.length[k]) & (head == self.head[k])
        tail = np.ascontiguousarray(eight[w.end[some]]).view("<u8")[:, 0]
        good &= (length < 8) | (tail == self.tail[k])
        fast = good & ~self.slow[k]
        out[some[fast]] = k[fast]
        for i in some[self.slow[k]].tolist():
            out[i] = self.at.get(w.word(i), -1)
        return out


class Queries:
    """A shard of items: their terms, and the corpus figures that scores need."""

    def __init__(self, items: list[tuple[int | None, list[str]]], b: int):
        words = sorted({w.encode() for _, ws in items for w in ws})
        self.vocabulary, self.items, self.b = Vocabulary(words), [i for i, _ in items], b
        at = self.vocabulary.at
        pairs = sorted((at[w.encode()], k) for k, (_, ws) in enumerate(items) for w in set(ws))
        self.term, self.item = np.array([t for t, _ in pairs], dtype=np.int64), np.array([k for _, k in pairs], dtype=np.int64)
        self.of: list[set[int]] = [set() for _ in items]
        for t, k in pairs:
            self.of[k].add(t)

    def with_figures(self, n_docs: int, n_words: int, df: np.ndarray) -> Queries:
        self.n_docs, self.n_words = n_docs, n_words
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        return self

    def part(self, n: np.ndarray, tf: np.ndarray | int) -> np.ndarray:
        """The factor of a term's weight in documents of n words where it occurs tf times, in whole numbers."""
        m = 100 - self.b + (self.b * n * self.n_docs) // max(1, self.n_words)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def bounds(self, slices: int, size: int, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """An upper bound of the score of each (item, document of a block)."""
        bits = bits.reshape(slices, -1)
        total = np.zeros((len(self.items), size))
        dtype = np.float32 if np.bincount(self.item, weights=self.weight[self.term], minlength=1).max() < 1 << 24 else np.float64
        terms, below, low = np.arange(len(self.vocabulary.words)), None, np.zeros(size, dtype=np.int64)
        for k in range(len(LEVELS)):
            at = _positions(_level_keys(self.vocabulary.hash[terms], k), slices)
            there = bits[at[0]]
            for p in at[1:]:
                there = there & bits[p]
            if below is not None:  # what is not at a level is not at a higher one
                there &= below
            some = there.any(axis=1)
            terms, below = terms[some], there[some]
            if not len(terms):
                break
            high = self.part(n, LEVELS[k + 1] - 1) if k + 1 < len(LEVELS) else np.full(size, 1_000_000, dtype=np.int64)
            place = np.full(len(self.vocabulary.words), -1, dtype=np.int64)
            place[terms] = np.arange(len(terms))
            at = place[self.term]
            weighted = np.zeros((len(self.items), size), dtype=dtype)
            for first in range(0, len(terms), STEP):
                use = np.flatnonzero((at >= first) & (at < first + STEP))
                matrix = np.zeros((len(self.items), min(STEP, len(terms) - first)), dtype=dtype)
                matrix[self.item[use], at[use] - first] = self.weight[self.term[use]]
                weighted += matrix @ np.unpackbits(below[first : first + STEP], axis=1, count=size).astype(dtype)
            total += weighted.astype(np.float64) * (high - low)
            low = high
        return total.astype(np.int64)

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, wanted: list[list[int]]) -> Iterator[tuple[int, int, int]]:
        """(row, item, score) of the items wanted for each row, exactly."""
        value = self.weight[term] * self.part(n[row], tf)
        cut = np.searchsorted(row, np.arange(len(wanted) + 1))
        for r, items in enumerate(wanted):
            own = dict(zip(term[cut[r] : cut[r + 1]].tolist(), value[cut[r] : cut[r + 1]].tolist()))
            for k in items:
                yield r, k, sum(v for t, v in own.items() if t in self.of[k])


def _figures(docs: DataFrame, queries: Queries) -> Queries:
    """The corpus figures: documents with a term, all terms, and for each query term the documents that hold it."""
    terms = len(queries.vocabulary.words)
    size = -(-(terms + 2) // WIDTH) * WIDTH
    sent = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for b, texts in parted(batches, "text", NOT_WORD):
            _, term, _, n = _counted(texts, b.num_rows, sent.value.places)
            total += np.bincount(term.astype(np.int64) + 2, minlength=size)
            total[0] += np.count_nonzero(n)
            total[1] += n.sum()
        yield from vector_rows(total, WIDTH)

    got = vector_sum(docs.select("text").mapInArrow(count, "slot int, kind string, places binary, counts binary"), size, WIDTH)
    return queries.with_figures(int(got[0]), int(got[1]), got[2 : terms + 2])


FOUND = "row long, doc_id long, item int, bound long"


def _bounded_rows(index: DataFrame, queries: Queries, k: int, least: np.ndarray | None, last: np.ndarray | None) -> DataFrame:
    """Rows of FOUND: in each block the ``k`` greatest bounds of each item, or, given the ``least`` score and the ``last``
    doc_id of each item's k-th document, all documents that may stand before or at it."""
    sent = index.sparkSession.sparkContext.broadcast((queries, least, last))

    def bound(batches):
        queries, least, last = sent.value
        for b in batches:
            for slices, size, doc_id, known, row, n, bits in zip(*(c.to_pylist() for c in b.columns)):
                ids, known, rows, n = np.frombuffer(doc_id, "<i8"), np.frombuffer(known, bool), np.frombuffer(row, "<i8"), np.frombuffer(n, "<i8")
                top = queries.bounds(slices, size, n, np.frombuffer(bits, np.uint8))
                if least is None:
                    at = np.argsort(-top, axis=1, kind="stable")[:, :k]
                    item, doc = np.repeat(np.arange(len(top)), at.shape[1]), at.reshape(-1)
                    some = top[item, doc] > 0
                    item, doc = item[some], doc[some]
                else:
                    rank = np.where(known, ids, np.iinfo(np.int64).max)
                    item, doc = np.nonzero((top > np.maximum(least, 0)[:, None]) | ((top == least[:, None]) & (least[:, None] > 0) & (rank[None, :] <= last[:, None])))
                if len(item):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), pa.array(ids[doc], mask=~known[doc]), pa.array(item.astype(np.int32)), pa.array(top[item, doc])], names=["row", "doc_id", "item", "bound"])

    return index.mapInArrow(bound, FOUND)


def _rescored(docs: DataFrame, queries: Queries, found: DataFrame, most_sent: int) -> DataFrame:
    """item, doc_id and exact score of the (row, item) pairs of ``found``, a written table, from the documents' texts."""
    wanted = found.groupBy("row").agg(F.collect_set("item").alias("items"))
    if found.count() <= most_sent:  # a row is a few dozen bytes
        wanted = F.broadcast(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def score(batches):
        for b, texts in parted(batches, "text", NOT_WORD):
            row, term, tf, n = _counted(texts, b.num_rows, sent.value.vocabulary.places)
            made = list(sent.value.scores(row, term.astype(np.int64), tf, n, b.column("items").to_pylist()))
            if made:
                r, item, s = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), b.column("doc_id").take(pa.array(r)), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])

    return docs.join(wanted, "row").select("doc_id", "text", "items").mapInArrow(score, "item int, doc_id long, score long")


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, most_words: int = 100_000, most_sent: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item, equal scores by doc_id.

    Terms are runs of ASCII letters and digits and of what is not ASCII, capitals A-Z as small letters; each distinct term
    of an item counts once. The items go in shards of about ``most_words`` words, a bound of what is broadcast and of the
    lists of k that meet on the driver; each shard passes over the index twice and over the texts for its figures and for
    rescoring. Candidates are broadcast up to ``most_sent``, and joined beyond it.

    Null and empty texts have no terms: as documents they count in no figure and are never found, as items they find
    nothing. Items of one id are one item with all their terms, null ids one item; repeated documents are found each by
    itself, a null doc_id after all others of its score. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = keyed(docs, id_col, text_col)
    index = written(signatures(rows))
    lowered = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))
    table = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(terms).alias("w")).groupBy("item_id").agg(F.collect_set("w").alias("ws"))
    n_words = table.agg(F.coalesce(F.sum(F.size("ws")), F.lit(0))).first()[0]
    shards = max(1, -(-n_words // most_words))
    out = None
    for shard in range(shards):
        own = [(r["item_id"], r["ws"]) for r in table.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id").collect()]
        found = _searched(rows, index, own, k, b, most_sent) if own else None
        if found is not None:
            out = found if out is None else out.union(found)
    removed(index)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _searched(rows: DataFrame, index: DataFrame, own: list[tuple[int | None, list[str]]], k: int, b: int, most_sent: int) -> DataFrame:
    spark = rows.sparkSession
    queries = _figures(rows, Queries(own, b))
    w = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
    seeds = written(_bounded_rows(index, queries, k, None, None).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k).drop("r"))
    least, last = np.zeros(len(own), dtype=np.int64), np.full(len(own), np.iinfo(np.int64).max)
    for r in _top(_rescored(rows, queries, seeds, most_sent), k).where(F.col("rank") == k).collect():  # one row for each item of the shard
        least[r["item"]] = r["score"]
        last[r["item"]] = np.iinfo(np.int64).max if r["doc_id"] is None else r["doc_id"]
    removed(seeds)
    found = written(_bounded_rows(index, queries, k, least, last))
    best = written(_top(_rescored(rows, queries, found, most_sent), k))
    removed(found)
    ids = spark.createDataFrame(list(enumerate(i for i, _ in own)), "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
