"""Which texts hold which words, by an index of the texts' tokens in place of a product of texts and words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from storyloom.plans.stored import stored

#: Characters by which the windows of a long token move on.
WINDOW = 256
#: Bytes of text in one slice, sets of words that meet it at once, and cells of a table of words and texts.
SLICE, SETS, CELLS = 4 << 20, 256, 32 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def holding(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, word): each text's id with the distinct words that are substrings of the text.

    texts: id (any type that joins), text; words: word. A word without blanks is in a text if it is in one of its tokens, so
    the distinct tokens are taken apart once into substrings as long as some word, and both joins are on equal keys. Words with blanks are looked up
    by their longest part and then held against the text. Null texts hold nothing, and words of blanks alone are held by none.
    """
    known = words.where(F.rlike("word", F.lit(r"[^\s]"))).select("word").distinct()
    parts = known.withColumn("part", F.expr(r"array_max(transform(split(word, r'\s+'), x -> named_struct('n', length(x), 'part', x))).part"))
    # the distinct lengths of words, which are few
    lengths, phrases = parts.agg(F.collect_set(F.length("part")), F.max(F.rlike("word", F.lit(r"\s")))).first()
    if not lengths:
        return texts.select("id", F.lit(None).cast("string").alias("word")).where("false")
    each = texts.select("id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("token")).where("token <> ''")
    reach = WINDOW + max(lengths) - 1
    each = each.select("id", F.explode(F.expr(f"transform(sequence(0, length(token) - 1, {WINDOW}), i -> substring(token, i + 1, {reach}))")).alias("token"))
    at = each.select("token").distinct().select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("at"))
    fits = f"transform(filter(array({', '.join(map(str, sorted(lengths)))}), n -> at + n - 1 <= length(token)), n -> substring(token, at, n))"
    found = at.select("token", F.explode(F.expr(fits)).alias("part")).join(parts, "part").select("token", "word").distinct()
    pairs = each.join(found, "token").select("id", "word").distinct()
    if phrases:
        pairs = pairs.join(texts.select("id", "text"), "id").where(F.contains("text", "word")).select("id", "word").distinct()
    return pairs


def names_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(work_id, id, name): the names of each text's own work that are in it. texts: work_id, id, text; names: work_id, name.

    Names and texts meet by the index of tokens, in all works at once; a text never meets a name that it does not hold.
    """
    own = names.where("name <> ''").select("work_id", "name").distinct()
    found = holding(texts.select(F.struct("work_id", "id").alias("id"), "text"), own.select(F.col("name").alias("word"))).select("id.work_id", "id.id", F.col("word").alias("name"))
    return found.join(own, ["work_id", "name"], "left_semi").select("work_id", "id", "name")


def _held(texts: list[bytes | None], words: list[bytes]) -> np.ndarray:
    """Whether each word (row) is a substring of each text (column). Words meet the texts by their first eight bytes, as one
    number; longer ones then by every further eight."""
    table = np.zeros((len(words), len(texts)), dtype=bool)
    data, ends = b"".join(t or b"" for t in texts), np.cumsum([len(t or b"") for t in texts])
    head = np.array([int.from_bytes(w[:8], "big") for w in words], dtype=np.uint64)
    size = np.array([len(w) for w in words])
    reach = int(size.max())
    for start in range(0, len(data), SLICE):
        raw = np.frombuffer(data[start : start + SLICE + reach] + bytes(8), dtype=np.uint8)
        key = np.zeros(len(raw) - 7, dtype=np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | raw[k : len(raw) - 7 + k]
        for n in np.unique(np.minimum(size, 8)):
            rows = np.flatnonzero(np.minimum(size, 8) == n)
            heads, place = np.unique(head[rows], return_inverse=True)
            own = key[: min(SLICE, len(data) - start)] >> np.uint64(64 - 8 * n)
            filled = np.zeros(1 << 16, dtype=bool)
            filled[heads * _FACTOR >> np.uint64(48)] = True
            at = np.flatnonzero(filled[own * _FACTOR >> np.uint64(48)])
            which = np.minimum(np.searchsorted(heads, own[at]), len(heads) - 1)
            same = heads[which] == own[at]
            at, which = at[same], which[same]
            text = np.searchsorted(ends, start + at, side="right")
            if n < 8:
                inside = start + at + n <= ends[text]
                table[rows[np.argsort(place)][which[inside]], text[inside]] = True
                continue
            by = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which[by], np.arange(len(heads) + 1))
            for row, h in zip(rows, place):
                some = by[bounds[h] : bounds[h + 1]]
                some = some[start + at[some] + size[row] <= ends[text[some]]]
                for o in [*range(8, size[row] - 8, 8), size[row] - 8]:
                    some = some[key[at[some] + o] == np.uint64(int.from_bytes(words[row][o : o + 8], "big"))]
                table[row, text[some]] = True
    return table


#: From the table of words and texts and each set's words (rows, one for each time it has the word): set, text and score of
#: what is found, and, once for each set, how many texts were scored for it.
Choice = Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def meeting(texts: DataFrame, sets: DataFrame, choose: Choice, order: list[str] | None = None, size: int = SLICE, most: int = SETS, cells: int = CELLS) -> DataFrame:
    """The pairs of a set of words and a text of its case that ``choose`` takes, with all columns of both, score and met.

    texts: case, text and others; sets: case, words and others, no two of one name but case. The texts of a case are dealt into
    slices of about ``size`` bytes and its sets into blocks of about ``most``; each slice meets each block once, so a text travels once
    for each block, and what its words are is never written. ``order`` sorts the texts of a slice, nulls last. ``choose`` gets
    at most ``cells`` cells of a table at a time, or one text. Words without anything but blanks and nulls are held by no text.
    """
    known = sets.withColumn("words", F.expr(r"transform(filter(words, w -> w RLIKE '[^\\s]'), w -> CAST(w AS BINARY))")).where("size(words) > 0")
    lots = texts.groupBy("case").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / size), F.lit(1)).cast("int").alias("__slices"))
    lots = stored(lots.join(known.groupBy("case").agg(F.ceil(F.count("*") / most).cast("int").alias("__blocks")), "case"))
    own, other = [c for c in texts.columns if c not in ("case", "text")], [c for c in sets.columns if c != "words"]
    dealt = texts.withColumn("text", F.col("text").cast("binary")).join(lots, "case").withColumn("__slice", F.expr("CAST(pmod(xxhash64(text), __slices) AS INT)"))
    dealt = dealt.select("case", "text", *own, "__slice", F.explode(F.expr("sequence(0, __blocks - 1)")).alias("__block"))
    asked = known.join(lots, "case").withColumn("__block", F.expr("CAST(pmod(xxhash64(words), __blocks) AS INT)"))
    asked = asked.select(*other, "words", "__block", F.explode(F.expr("sequence(0, __slices - 1)")).alias("__slice"))
    schema = StructType([*(sets.schema[c] for c in other), *(texts.schema[c] for c in own), StructField("score", DoubleType()), StructField("met", LongType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if order and left.num_rows:
            left = left.sort_by([(c, "ascending") for c in order])
        lists = right.column("words").to_pylist()
        words = list(dict.fromkeys(w for ws in lists for w in ws))
        place = {w: i for i, w in enumerate(words)}
        rows = [np.array([place[w] for w in ws]) for ws in lists]
        out = []
        step = max(1, cells // max(1, len(words)))
        for start in range(0, left.num_rows if words else 0, step):
            some = left.slice(start, step)
            i, j, score, met = choose(_held(some.column("text").to_pylist(), words), rows)
            columns = [*(right.column(c).take(pa.array(i)) for c in other), *(some.column(c).take(pa.array(j)) for c in own)]
            out.append(pa.table([*columns, pa.array(score, pa.float64()), pa.array(met, pa.int64())], names=[*other, *own, "score", "met"]))
        if out:
            return pa.concat_tables(out)
        return pa.table([*(right.column(c).slice(0, 0) for c in other), *(left.column(c).slice(0, 0) for c in own), pa.array([], pa.float64()), pa.array([], pa.int64())], names=[*other, *own, "score", "met"])

    key = ["case", "__slice", "__block"]
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, asked = (t.repartition(parts, *key).groupBy(*key) for t in (dealt, asked))
    return dealt.cogroup(asked).applyInArrow(meet, schema)
