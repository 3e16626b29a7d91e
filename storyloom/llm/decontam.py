"""Benchmark decontamination: a BM25 index of the test items with block-max WAND, then verified question and answer overlap.

The inverted index holds the test items, and every document is a query. Terms are the word n-grams that the overlap test
counts, so the least score of an item that can pass the test follows from it: all its weight but the heaviest terms that may be
missing. Impacts are shares of that least score, which makes one threshold, 1, hold for all items and lose none. Cursors over
the posting lists stand by item; the first at which the lists' greatest impacts can reach the threshold is the pivot, blocks
whose maxima cannot are skipped, and only what is left is scored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import bounded, id_text
from storyloom.llm.textkernel import _SPACE, Words, mix, parted

BLOCK = 8
K1, B = 1.2, 0.75
NEAR = 1e-6


def plain(texts: pa.Array) -> pa.Array:
    """Small letters and digits, all else a blank."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")


def runs(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words of one row, from the words' hashes and rows."""
    n = max(0, len(h) - k + 1)
    g = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        g = (g ^ h[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        g = g ^ (g >> np.uint64(32))
    whole = of[:n] == of[k - 1 : k - 1 + n]
    return of[:n][whole], mix(g[whole])


class ItemIndex:
    """The index of one shard of items: for each its question's and its answer's distinct terms, and how often each occurs.

    items: (question terms, answer terms, {term: count}) of each item; df: of each term, over all shards.
    """

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray, dict[int, int]]], df: dict[int, int], n_items: int, mean: float, share: float):
        item, term, weight, self.whole = [], [], [], np.zeros(len(items))
        for i, (q, a, tf) in enumerate(items):
            t = np.unique(np.concatenate([q, a]))
            size = sum(tf.values())
            each = np.array([tf[int(x)] for x in t], dtype=np.float64)
            often = np.array([df[int(x)] for x in t], dtype=np.float64)
            w = np.log(1 + (n_items - often + 0.5) / (often + 0.5)) * each * (K1 + 1) / (each + K1 * (1 - B + B * size / max(mean, 1e-9)))
            missing = sum(len(p) - int(np.ceil(share * len(p) - NEAR)) for p in (q, a))
            least = w.sum() - np.sort(w)[::-1][:missing].sum()
            self.whole[i] = w.sum() / max(least, 1e-12)
            item.append(np.full(len(t), i))
            term.append(t)
            weight.append(w / max(least, 1e-12))
        none = np.zeros(0)
        item, term, weight = (np.concatenate(x) if x else none.astype(k) for x, k in ((item, np.int64), (term, np.uint64), (weight, float)))
        order = np.lexsort((item, term))
        item, term, weight = item[order], term[order], weight[order]
        self.terms, first = np.unique(term, return_index=True)
        ends = np.append(first, len(term)).tolist()
        self.items = [item[a:b].tolist() for a, b in zip(ends, ends[1:])]
        self.weights = [weight[a:b].tolist() for a, b in zip(ends, ends[1:])]
        self.tops = [[max(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)] for w in self.weights]
        self.top = [max(t) for t in self.tops]
        self.parts = [(set(np.searchsorted(self.terms, q).tolist()), set(np.searchsorted(self.terms, a).tolist())) for q, a, _ in items]

        # the places of terms by the first bits of their hashes; where two terms meet, the sorted terms are searched
        bits = min(24, max(16, len(self.terms).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        at = (self.terms >> self.shift).astype(np.int64)
        self.slot[at] = np.arange(len(self.terms))
        self.slot[at[:-1][at[1:] == at[:-1]]] = -2

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in terms, -1 for others."""
        k = self.slot[h >> self.shift]
        meet = np.flatnonzero(k == -2)
        k[meet] = np.minimum(np.searchsorted(self.terms, h[meet]), len(self.terms) - 1)
        k[(k >= 0) & (self.terms[k] != h)] = -1
        return k

    def find(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items whose impacts over the distinct ``terms`` (places) sum up to the threshold, by item."""
        least, out = 1 - NEAR, []
        cursors = [[self.items[t][0], 0, t] for t in terms]  # the item it stands at, the place of that in its list, the list
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.top[c[2]]
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            k += sum(1 for c in cursors[k + 1 :] if c[0] == pivot)
            bound, until = 0.0, cursors[k + 1][0] if k + 1 < len(cursors) else None
            for _, at, t in cursors[: k + 1]:
                at = bisect_left(self.items[t], pivot, at)
                if at < len(self.items[t]):
                    block = at // BLOCK
                    bound += self.tops[t][block]
                    after = self.items[t][min(len(self.items[t]), (block + 1) * BLOCK) - 1] + 1
                    until = after if until is None else min(until, after)
            if bound < least:  # nothing up to the end of the nearest block, or to the next cursor, can reach it
                to = max(pivot + 1, until if until is not None else pivot + 1)
                moved = cursors[: k + 1]
            elif cursors[0][0] == pivot:
                score = sum(self.weights[t][at] for i, at, t in cursors[: k + 1])
                if score >= least:
                    out.append((pivot, score))
                to, moved = pivot + 1, cursors[: k + 1]
            else:
                to, moved = pivot, [c for c in cursors[: k + 1] if c[0] < pivot]
            for c in moved:
                c[1] = bisect_left(self.items[c[2]], to, c[1])
                c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out


def _part_terms(w: Words, h: np.ndarray, i: int, n: int) -> np.ndarray:
    """The terms of text i: its runs of ``n`` words, or, if it is shorter, the whole as one; repeats stay."""
    own = h[w.first[i] : w.first[i + 1]]
    return runs(own, np.zeros(len(own), dtype=np.int64), min(n, len(own)))[1] if len(own) else np.zeros(0, dtype=np.uint64)


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, most_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for each document that holds a test item.

    A leak holds num / den of the distinct n-word runs of the question, and as many of the answer's, anywhere in the document; a
    part of fewer than n words counts as one run. All leaks are found: the index is asked for every item that could be one.
    score is the share of the item's BM25 weight in the document. Items go in shards of about ``most_words`` words, a bound for
    what is broadcast; each shard is one more pass over the documents. A text is read in parts, so its length does not bound
    it. Null or empty texts and items match nothing; a null answer is left out of the test; repeated rows give repeated
    results; null keys stay; no rows on either side give none.
    """
    spark = docs.sparkSession
    bounded(spark, 2 << 20)
    rows = id_text(docs, id_col, text_col)
    table = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(question_col, F.lit("")).alias("q"), F.coalesce(answer_col, F.lit("")).alias("a")).distinct()

    def terms(batches):
        for b in batches:
            found, size = [], np.zeros(b.num_rows, dtype=np.int64)
            for c in ("q", "a"):
                w = Words(plain(b.column(c)))
                h = w.hashes()
                for i in range(b.num_rows):
                    t = _part_terms(w, h, i, n)
                    size[i] += len(t)
                    found.append(np.stack([np.full(len(t), i, dtype=np.uint64), t], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"term": pa.array(pairs[:, 1].copy().view(np.int64)), "size": pa.array(np.zeros(len(pairs), dtype=np.int64))})
            yield pa.RecordBatch.from_pydict({"term": pa.array([None] * b.num_rows, pa.int64()), "size": pa.array(size)})

    counted = table.mapInArrow(terms, "term long, size long")
    n_items, n_terms = counted.where("term IS NULL AND size > 0").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    frequency = counted.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    shards = max(1, -(-n_terms // most_words))
    out = None
    for shard in range(shards):
        own = table.where(F.pmod(F.xxhash64("q", "a"), F.lit(shards)) == shard) if shards > 1 else table
        df = {t % (1 << 64): k for t, k in own.mapInArrow(terms, "term long, size long").where("term IS NOT NULL").select("term").distinct().join(frequency, "term").toLocalIterator()}
        found = _scan(rows, own.orderBy("item_id", "q", "a").collect(), df, n_items, n_terms / max(1, n_items), n, num / den)
        out = found if out is None else out.union(found)
    return out


def _scan(rows: DataFrame, items: list, df: dict[int, int], n_items: int, mean: float, n: int, share: float) -> DataFrame:
    ids, shard, lengths = [], [], set()
    sides = [(w, w.hashes()) for w in (Words(plain(pa.array([r[k] for r in items], pa.string()))) for k in ("q", "a"))]
    for i, r in enumerate(items):
        parts = [_part_terms(w, h, i, n) for w, h in sides]
        if len(parts[0]) + len(parts[1]):
            lengths |= {min(n, int(w.count[i])) for w, _ in sides if w.count[i]}
            every, count = np.unique(np.concatenate(parts), return_counts=True)
            ids.append(r["item_id"])
            shard.append((np.unique(parts[0]), np.unique(parts[1]), dict(zip(every.tolist(), count.tolist()))))
    sent = rows.sparkSession.sparkContext.broadcast((ItemIndex(shard, df, n_items, mean, share), ids))
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def held(texts: Iterator[tuple[pa.Array, bool]], index: ItemIndex, n_rows: int) -> list[set[int]]:
        """The index's terms that each row holds, over all parts of a text."""
        out: list[set[int]] = [set() for _ in range(n_rows)]
        h, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for t, part in texts:
            w = Words(plain(t))
            keep = min(n - 1, len(h)) if part else 0  # the words before, for runs that began there
            h, of = np.concatenate([h[len(h) - keep :], w.hashes()]), np.concatenate([of[len(of) - keep :], w.doc])
            for k in lengths:
                row, g = runs(h, of, k)
                at = index.places(g)
                for r, x in zip(row[at >= 0].tolist(), at[at >= 0].tolist()):
                    out[r].add(x)
        return out

    def scan(batches):
        index, ids = sent.value
        for b, texts in parted(batches, "text", _SPACE, 250_000):
            if not len(index.terms):
                continue
            out = []
            for d, there in enumerate(held(texts, index, b.num_rows)):
                for i, score in index.find(sorted(there)) if there else ():
                    over = [len(p & there) / len(p) if p else 0.0 for p in index.parts[i]]
                    if all(x >= share - NEAR or not p for x, p in zip(over, index.parts[i])):
                        out.append((d, ids[i], min(1.0, score / index.whole[i]), *over))
            if out:
                d, *rest = zip(*out)
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), *(pa.array(x, k) for x, k in zip(rest, kinds))], names=names)

    return rows.mapInArrow(scan, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def question_answer(items: DataFrame, text_col: str = "text") -> DataFrame:
    """Items of one text as question and answer: the answer is the last sentence of five words or more with all that
    follows it, the question all before; a single sentence is all question and has no answer."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = F.regexp_extract(text, r"(?s)^(.*[.?!])\s+\S+(?:\s+\S+){4,}\s*$", 1)
    return items.withColumn("question", F.when(F.trim(head) == "", text).otherwise(head)).withColumn("answer", F.when(F.trim(head) == "", F.lit(None).cast("string")).otherwise(F.expr(f"substring(coalesce({text_col}, ''), length(question) + 1)")))
