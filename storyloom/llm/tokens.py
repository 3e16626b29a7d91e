"""Token ids of whole documents from a public tokenizer file.

The tokenizer drops white space and treats what stands between it on its own, and it parts
letters from the marks after them, so a document's ids are those of its words in order. Each worker encodes a distinct word once and keeps its ids in a bounded
cache, which every later document shares.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from storyloom.llm.textkernel import _LOWER, Words

MARK, MARK_ID = "<|startoftext|>", 49406
_loaded: dict[str, Encoder] = {}


class Encoder:
    """ids and lengths of texts. ``most_words`` bounds the cache; beyond it, the cache starts anew."""

    def __init__(self, path: str, most_words: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.most = most_words
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.ids = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.uint16))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number for each word.

        Small ASCII letters go straight to the vocabulary's model; other words of letters alone are one unit each,
        which a token with the word-end suffix closes; the rest is parted by a special token, or, if it holds one
        itself, encoded alone.
        """
        kind = [0 if w.isascii() and w.isalpha() and w.islower() else 1 if w.isalpha() else 3 if "<|" in w else 2 for w in words]
        sizes, found = np.zeros(len(words), dtype=np.int64), []
        for k in range(4):
            some = [i for i, x in enumerate(kind) if x == k]
            for at in range(0, len(some), 5000):
                part = some[at : at + 5000]
                these = [words[i] for i in part]
                if k in (0, 3):
                    each = [[t.id for t in self.tokenizer.model.tokenize(w)] for w in these] if k == 0 else [self.tokenizer.encode(w, add_special_tokens=False).ids for w in these]
                    size = [len(x) for x in each]
                    ids = np.array([i for x in each for i in x], dtype=np.uint16)
                else:
                    got = np.array(self.tokenizer.encode_batch_fast([(" " if k == 1 else MARK).join(these)], add_special_tokens=False)[0].ids, dtype=np.uint16)
                    ids = got if k == 1 else got[got != MARK_ID]
                    size = np.diff(np.concatenate([[-1], np.flatnonzero(self.ends[got])])) if k == 1 else np.diff(np.concatenate([[-1], np.flatnonzero(got == MARK_ID), [len(got)]])) - 1
                sizes[part] = size
                found.append((part, ids))
        flat = np.zeros(int(sizes.sum()), dtype=np.uint16)
        at = np.cumsum(sizes) - sizes
        for part, ids in found:
            size = sizes[part]
            flat[np.repeat(at[part] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return flat, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint16, ids of each text)."""
        w = Words(texts, part=True)
        raw = w.data.tobytes()
        if b"<|" not in raw:  # else a word in capitals could turn into a special token
            w.data = _LOWER[w.data]
            raw = w.data.tobytes()
        if not len(w.start):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(texts), dtype=np.int64)
        keys, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            ids, sizes = self._encode([raw[s:e].decode("utf-8", "replace") for s, e in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())])
            at = len(self.ids) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.ids = np.concatenate([self.ids, ids])
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys, kind="stable")
            self.keys, self.at, self.size = all_keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]
            where = np.searchsorted(self.keys, keys)
        size, at = self.size[where][inverse], self.at[where][inverse]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        per_text = np.bincount(w.doc, weights=size, minlength=len(texts)).astype(np.int64)
        return flat, per_text


def encoder(path: str) -> Encoder:
    """One encoder for each file in a worker; its cache lasts from task to task."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_tokenizer() -> str:
    """The file that the registered queries use; the package that holds it is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
