"""Token counts under a unigram vocabulary by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the vocabulary's word-begin mark. The best segmentation's forward score at a prefix does
not depend on what follows, so words that share a prefix share its scores: each trie node keeps the best score of
its prefix and the number of pieces in it, which at a word's last node is the word's token count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyloom.llm.shared import bounded, id_text
from storyloom.llm.textkernel import Words, pieces

MARK = "▁"


def rank_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities by Zipf's law from the pieces in order of rank; the first of repeated pieces counts."""
    total = sum(1 / (r + 10) for r in range(len(pieces)))
    out: dict[str, float] = {}
    for r, p in enumerate(pieces):
        out.setdefault(p, -math.log((r + 10) * total))
    return out


def piece_vocabulary(path: str) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece file in order of id, which is their rank, as unigram scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return rank_scores([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


class CountTrie:
    """Token counts of pre-tokens. A character that no piece covers costs its UTF-8 bytes, each a token."""

    def __init__(self, scores: dict[str, float], most_nodes: int = 400_000, longest_stored: int = 64):
        self.scores, self.most, self.stored = scores, most_nodes, longest_stored
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def _step(self, word: str, d: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Forward score and tokens of word[:d]; best and count hold those of the shorter prefixes, the nearest last."""
        get, top, tokens = self.scores.get, -math.inf, 0
        for k in range(1, min(self.longest, d) + 1):
            s = get(word[d - k : d])
            if s is not None:
                v = best[-k] + s
                if v > top or (v == top and count[-k] + 1 < tokens):
                    top, tokens = v, count[-k] + 1
        if word[d - 1] not in self.scores:
            n = len(word[d - 1].encode("utf-8", "surrogatepass"))
            if (v := best[-1] + n * self.byte) > top:
                top, tokens = v, count[-1] + n
        return top, tokens

    def tokens(self, word: str) -> int:
        """The token count of one pre-token. Prefixes beyond ``longest_stored`` characters are computed but not stored, and a full trie starts anew."""
        if len(self.best) > self.most:
            self._clear()
        node, best, count = 0, [0.0], [0]
        for d in range(1, len(word) + 1):
            following = self.child.get((node, word[d - 1])) if d <= self.stored and node >= 0 else None
            if following is None:
                b, c = self._step(word, d, best, count)
                if d <= self.stored:
                    following = len(self.best)
                    self.child[node, word[d - 1]] = following
                    self.best.append(b)
                    self.count.append(c)
                else:
                    following = -1
            else:
                b, c = self.best[following], self.count[following]
            node = following
            best.append(b)
            count.append(c)
            if len(best) > 4 * self.longest + 64:
                del best[: -self.longest], count[: -self.longest]
        return count[-1]


class _Counter:
    """Counts of words by hash, over a trie, with a bounded cache of sorted arrays."""

    def __init__(self, scores: dict[str, float], most_words: int = 2_000_000):
        self.trie, self.most = CountTrie(scores), most_words
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def __call__(self, w: Words) -> np.ndarray:
        keys, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.keys, self.counts = self.keys[:0], self.counts[:0]
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = w.data.tobytes()
            words = [MARK + raw[s:e].decode("utf-8", "replace") for s, e in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())]
            counts = np.zeros(len(words), dtype=np.int64)
            for k in sorted(range(len(words)), key=words.__getitem__):
                counts[k] = self.trie.tokens(words[k])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.counts = merged[order], np.concatenate([self.counts, counts])[order]
            where = np.searchsorted(self.keys, keys)
        return self.counts[where][inverse]


_counters: dict[int, _Counter] = {}


def _counter(key: int, vocabulary) -> _Counter:
    """A worker's counter of a vocabulary; its cache lasts from task to task."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = _Counter(vocabulary.value)
    return _counters[key]


def token_counts(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document's whole text, without a shuffle.

    Pre-tokens are runs without ASCII white space. A null or empty text has none of either; repeated rows and null
    keys stay; extra columns are left behind.
    """
    spark = docs.sparkSession
    bounded(spark)
    vocabulary = spark.sparkContext.broadcast(scores)
    key = hash(frozenset(scores.items()))

    def count(batches):
        counter = _counter(key, vocabulary)
        for b in pieces(batches, "text"):
            w = Words(b.column("text"))
            n = np.zeros(b.num_rows) if not len(w.start) else np.bincount(w.doc, weights=counter(w), minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(n.astype(np.int64))], names=["doc_id", "n_pretokens", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
