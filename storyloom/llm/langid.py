"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

The model is a table of byte n-gram counts of fixed size for each language. A word's score for a language is the
log-likelihood of the n-grams around its letters; changing language between words costs a penalty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import VECTOR, bounded, vector_rows, vector_sum
from storyloom.llm.textkernel import pieces

BITS = 16
WIDTH = 4096
#: The share of a language's expected fit from which a text fits fully.
FULL = 0.5
#: First code points of the ranges that part scripts, and each range's script.
SCRIPT_FROM = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])
SCRIPT_NAME = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "hangul", "other", "han", "other", "hangul", "other", "han", "other", "han"]
SCRIPTS = sorted(set(SCRIPT_NAME))
_SCRIPT_OF = np.array([SCRIPTS.index(s) for s in SCRIPT_NAME])
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SMALL = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_SMALL[65:91] += 32



class _Letters:
    """The letters of an Arrow text array: n-gram codes around each, and the words they make."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offs, data = texts.buffers()
        bounds = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        # a blank after each text, and two before and behind all
        at = bounds - bounds[0] + np.arange(len(bounds)) + 2
        b = np.full(len(raw) + len(texts) + 4, 32, dtype=np.uint8)
        b[np.arange(len(raw)) + np.repeat(np.arange(len(texts)), np.diff(bounds)) + 2] = _SMALL[raw]
        up = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[up] += 0x20  # capitals of the Latin-1 range
        inside = b != 32
        pos = np.flatnonzero(inside)
        self.pos, self.bytes = pos, b
        w = b.astype(np.uint64)
        three = (w[pos - 1] << np.uint64(16)) | (w[pos] << np.uint64(8)) | w[pos + 1]
        self.long = inside[pos + 1]
        four = (three << np.uint64(8)) | w[np.minimum(pos + 2, len(b) - 1)]
        mul = np.uint64(0x9E3779B97F4A7C15)
        self.g3 = ((three * mul) >> np.uint64(64 - BITS)).astype(np.int64)
        self.g4 = ((four * mul + mul) >> np.uint64(64 - BITS)).astype(np.int64)
        self.begin = np.flatnonzero(~inside[pos - 1])  # places in pos where words begin
        self.end = np.concatenate([self.begin[1:], [len(pos)]]) if len(pos) else self.begin
        self.doc = np.searchsorted(at, pos[self.begin], side="right") - 1
        self.at = at

    def scripts(self) -> tuple[np.ndarray, np.ndarray]:
        """The script of each word's first letter, and the letters (not bytes) of each word."""
        b, p = self.bytes.astype(np.int64), self.pos[self.begin]
        c, x, y = b[p], b[p + 1], b[np.minimum(p + 2, len(b) - 1)]
        code = np.where(c < 0x80, c, np.where(c < 0xE0, ((c & 31) << 6) | (x & 63), np.where(c < 0xF0, ((c & 15) << 12) | ((x & 63) << 6) | (y & 63), 0x20000)))
        lead = np.concatenate([[0], np.cumsum((b[self.pos] & 0xC0) != 0x80)])
        return _SCRIPT_OF[np.searchsorted(SCRIPT_FROM, code, side="right") - 1], lead[self.end] - lead[self.begin]


@dataclass
class Model:
    langs: list[str]
    three: np.ndarray  # (2 ** BITS, languages) log-probabilities
    four: np.ndarray
    allowed: np.ndarray  # (scripts, languages)


def _levels(model: Model) -> np.ndarray:
    """(4, languages): the mean log-probability of the three- and four-byte n-grams, as the language has them and of any."""
    tables = (model.three.astype(np.float64), model.four.astype(np.float64))
    return np.stack([*((np.exp(x) * x).sum(axis=0) for x in tables), *(x.mean(axis=0) for x in tables)])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_langs: int = 256, alpha: float = 0.1) -> Model:
    """Count the n-grams of all labelled texts. Rows with a null text or label are left out; more than ``most_langs``
    labels raise an error, as the model is broadcast and its size is theirs times 2 ** (BITS + 1)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    at, size = {x: k for k, x in enumerate(langs)}, 2 * (1 << BITS) + WIDTH

    def count(batches):
        total = np.zeros((max(1, len(langs)), size), dtype=np.int64)
        for b in pieces(batches, "text"):
            own = np.array([at[x] for x in b.column("lang").to_pylist()])
            for k in np.unique(own):
                t = _Letters(b.column("text").filter(pa.array(own == k)))
                total[k, : 1 << BITS] += np.bincount(t.g3, minlength=1 << BITS)
                total[k, 1 << BITS : 2 << BITS] += np.bincount(t.g4[t.long], minlength=1 << BITS)
                script, letters = t.scripts()
                total[k, 2 << BITS : (2 << BITS) + len(SCRIPTS)] += np.bincount(script, weights=letters, minlength=len(SCRIPTS)).astype(np.int64)
        yield from vector_rows(total.reshape(-1), WIDTH)

    counts = vector_sum(rows.mapInArrow(count, VECTOR), max(1, len(langs)) * size, WIDTH).reshape(-1, size)[: len(langs)]
    logs = [np.log((c + alpha) / (c.sum(axis=1, keepdims=True) + alpha * c.shape[1])).T.astype(np.float32) for c in (counts[:, : 1 << BITS], counts[:, 1 << BITS : 2 << BITS])]
    script = counts[:, 2 << BITS : (2 << BITS) + len(SCRIPTS)].astype(float)
    allowed = (script >= 0.001 * np.maximum(1, script.sum(axis=1, keepdims=True))) & (script > 0)
    return Model(langs, np.ascontiguousarray(logs[0]), np.ascontiguousarray(logs[1]), allowed.T)


def _viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; staying is free and changing costs ``penalty``. Ties go to staying, then to the first language."""
    rows = scores.tolist()
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(best)
        floor = top - penalty
        if min(best) < floor:
            first = best.index(top)
            back.append([first if x < floor else k for k, x in enumerate(best)])
            best = [(floor if x < floor else x) + s for x, s in zip(best, row)]
        else:  # nobody gains by changing here
            back.append(None)
            best = [x + s for x, s in zip(best, row)]
    at = best.index(max(best))
    path = [at]
    for b in reversed(back):
        at = at if b is None else b[at]
        path.append(at)
    return np.array(path[::-1])


def _label(scores: np.ndarray, penalty: float) -> np.ndarray:
    """As _viterbi. Where no run of words favours another language by more than half the penalty, the path that never changes is best."""
    top = int(scores.sum(axis=0).argmax())
    gain = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores - scores[:, [top]], axis=0, dtype=np.float64)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(len(scores), top)
    return _viterbi(scores, penalty)


def identify(docs: DataFrame, model: Model, penalty: float = 24.0, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and lang_spans (lang:first word:words, comma-joined).

    lang_pred is the language of most letters. score, in [0, 1], is their share, without words in a script that the
    language does not use, times the fit: how far the log-likelihood along the path lies from that of any n-gram (0) to
    FULL of the way to that of the labelled texts (1). Words are runs of letters. A null text,
    a text without a letter, and any text under a model without languages get ``und``, 0 and ''. A word in a script
    that no language uses favours none. Columns of these names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    bounded(spark)
    m = spark.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score", "lang_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def label(batches):
        model = m.value
        names, levels = [*model.langs, "und"], _levels(model)
        for b in pieces(batches, text_col):
            n = b.num_rows
            pred, score, spans = np.full(n, len(model.langs)), np.zeros(n), [""] * n
            t = _Letters(b.column(text_col))
            if len(t.begin) and model.langs:
                raw = model.three[t.g3] + model.four[t.g4] * t.long[:, None]
                likely = words = np.add.reduceat(raw, t.begin, axis=0)
                size, longs = t.end - t.begin, np.add.reduceat(t.long.astype(np.int64), t.begin)
                script, letters = t.scripts()
                allowed = model.allowed[script]
                words = np.where(allowed | ~allowed.any(axis=1, keepdims=True), words, words.min(axis=1, keepdims=True) - 8)
                words[~allowed.any(axis=1)] = 0
                cuts = np.searchsorted(t.doc, np.arange(n + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[i], cuts[i + 1])
                    p = t.pos[t.begin[own]]
                    if t.bytes[p].min() >= 128 and not (t.bytes[t.pos[t.begin[own.start] : t.end[own.stop - 1]]] < 128).any():
                        if not any(ch.isalpha() for ch in b.column(text_col)[int(i)].as_py()):
                            continue  # marks and symbols beyond ASCII
                    path = _label(words[own], penalty)
                    weight = np.bincount(path, weights=letters[own], minlength=len(model.langs))
                    pred[i] = weight.argmax()
                    own_script = letters[own] * allowed[own][np.arange(len(path)), path]
                    text, any3, any4 = levels[:2, path], *levels[2:, path]
                    least = any3 @ size[own] + any4 @ longs[own]
                    usual = text[0] @ size[own] + text[1] @ longs[own]
                    fit = (likely[own][np.arange(len(path)), path].sum(dtype=np.float64) - least) / max(FULL * (usual - least), 1e-9)
                    score[i] = own_script[path == pred[i]].sum() / weight.sum() * min(1.0, max(0.0, fit))
                    change = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
                    spans[i] = ",".join(f"{names[path[s]]}:{s}:{e - s}" for s, e in zip(change[:-1], change[1:]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([names[k] for k in pred]), pa.array(score), pa.array(spans)], names=[*b.schema.names, "lang_pred", "score", "lang_spans"])

    return rest.mapInArrow(label, f"{schema}, lang_pred string, score double, lang_spans string")
