"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing.

A plan needs only how many pieces there are of each length, which is one number per length up to the capacity,
whatever the corpus size. The driver makes the plan from these counts; pieces find their places in it in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.shared import bounded, id_text, written
from storyloom.llm.textkernel import pieces as slices
from storyloom.llm.tokens import encoder

#: Bytes of text that are encoded at a time.
SLICE = 250_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids plus ``end_id``, cut into pieces of ``capacity`` ids where it is longer.

    Rows: doc_id, piece, start, length, ids_crc32, part, local (the piece's rank among those of its length in its
    part) and, with ``keep_ids``, ids. A null or empty text is the end id alone; a null doc_id stays null; repeated
    rows are separate documents.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids array<int>" * keep_ids

    def cut(batches):
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in slices(batches, "text", SLICE):
            flat, sizes = encode(b.column("text"))
            ends = np.cumsum(sizes)
            rows: list[tuple] = []
            for k, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                ids = np.append(flat[end - size : end], end_id).astype("<u4")
                for p, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((k, p, start, len(own), zlib.crc32(own.tobytes()), seen[len(own)], own if keep_ids else None))
                    seen[len(own)] += 1
            k, piece, start, length, crc, local, own = zip(*rows)
            cols = [b.column("doc_id").take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(k), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))] if keep_ids else []), names=names)

    bounded(docs.sparkSession, 2 << 20)
    return id_text(docs, id_col, text_col).mapInArrow(cut, schema)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used, so that every piece is in one.

    Exact complements come first: for the largest length left, its gap is looked up among single lengths, sums of
    two and sums of three, and the combination is consumed as often as its counts allow. What has no complement is
    packed best fit. A step uses up at least one length (but for an odd one), so the plan has a few thousand patterns
    at most.
    """
    left, out = counts.astype(np.int64).copy(), []

    def take(lengths: list[int]) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        n = int((left[used] // need[used]).min())
        left[used] -= n * need[used]
        out.append((sorted(lengths, reverse=True), n))

    def two(gap: int, a: int) -> list[int] | None:
        """The pair with this sum that can be used most often."""
        if gap < 2:
            return None
        b = np.arange(1, gap // 2 + 1)
        free = left.copy()
        free[a] -= 1
        n = np.where(2 * b == gap, free[b] // 2, np.minimum(free[b], free[gap - b]))
        k = int(n.argmax())
        return [int(b[k]), gap - int(b[k])] if n[k] > 0 else None

    def three(gap: int, a: int) -> list[int] | None:
        for b in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if left[b] - (a == b) > 0:
                left[b] -= 1
                rest = two(gap - b, a)
                left[b] += 1
                if rest and rest[0] <= rest[1] <= b:
                    return [b, *rest]
        return None

    for a in range(capacity, 0, -1):
        while left[a] > 0:
            gap = capacity - a
            if gap == 0:
                take([a])
                continue
            one = [gap] if left[gap] - (gap == a) > 0 else None
            rest = one or two(gap, a) or three(gap, a)
            if not rest:
                break
            take([a, *rest])
    while left.any():
        free, lengths, gap = left.copy(), [], capacity
        while gap > 0 and (fits := np.flatnonzero(free[: gap + 1])).size:
            x = int(fits[-1])
            lengths.append(x)
            free[x] -= 1
            gap -= x
        take(lengths)
    return out


def pack(table: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces (from ``token_pieces``) with sequence_id and offset; the offsets of a sequence are gapless from 0.

    A piece's rank among those of its length is its rank in its part plus the pieces in the parts before, so no
    length is gathered anywhere, however common. An empty table gives an empty result.
    """
    table = written(table)
    counts = written(table.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length up to the capacity
        total[r["length"]] = r["n"]
    used, slots, base = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for lengths, n in plan(total, capacity):
        offset = 0
        for x in lengths:
            slots.append((x, used[x], base, offset))
            used[x] += n
            offset += x
        base += n
    slots.sort()
    length, first, sequence, offset = (np.array(x, dtype=np.int64) for x in (zip(*slots) if slots else ([],) * 4))
    keys = (length << 48) | first

    def place(batches):
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, (size << 48) | rank, side="right") - 1
            cols = {n: b.column(n) for n in b.schema.names if n != "rank"} | {"sequence_id": pa.array(sequence[k] + rank - first[k]), "offset": pa.array(offset[k])}
            yield pa.RecordBatch.from_pydict(cols)

    ranked = table.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "part")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves from placed pieces with ids: sequence_id, ids, doc_ids. A sequence has ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
