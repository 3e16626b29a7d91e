"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector is turned by a random rotation and kept as its signs (the code) with a correction factor, the inner product of
the unit vector and its code. Signs of such rotations also part the vectors into buckets, in several tables, so that
near vectors meet in at least one. There, code and factor give an unbiased estimate of each inner product with a
confidence bound, and only pairs that may reach the threshold are computed exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.components import components
from storyloom.llm.shared import bounded, written

_turns: dict[tuple[int, int], np.ndarray] = {}
BUCKET = ["label", "dim", "t", "key"]


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every worker."""
    if (dim, number) not in _turns:
        q, r = np.linalg.qr(np.random.default_rng([dim, number, 4711]).standard_normal((dim, dim)))
        _turns[dim, number] = q * np.sign(np.diag(r))
    return _turns[dim, number]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs of the rotated unit vectors as booleans, correction factors)."""
    y = unit @ rotation(unit.shape[1], 0).T
    return y > 0, np.abs(y).sum(axis=1) / math.sqrt(unit.shape[1])


def estimate(unit: np.ndarray, signs: np.ndarray, factor: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of all unit vectors (rows) with all coded ones (columns), and the bound of each column's error."""
    d = unit.shape[1]
    y = unit @ rotation(d, 0).T
    inner = y @ ((2.0 * signs - 1) / math.sqrt(d)).T / factor
    return inner, width * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))


def tables_for(n: int, cosine: float, miss: float = 0.01) -> tuple[int, int]:
    """(bits of a bucket key, tables): buckets of about 32 unrelated vectors, and so many tables that a pair at the
    threshold is missed with probability ``miss`` at most."""
    bits = min(24, max(8, round(math.log2(max(1, n) / 32))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def near_duplicates(table: DataFrame, cosine: float = 0.93, width: float = 4.0, block: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links are other rows of the same label with this cosine or more.

    Equal vectors are one class with its number of rows, so copies are not compared with each other. Large buckets
    are compared block by block. Rows with a null label, or a vector that is null, empty, zero or holds a null or
    non-finite component, link with nothing; vectors of different length do not link. Repeated rows count as other rows.
    A null key stays null. Extra columns are left behind.
    """
    spark = table.sparkSession
    bounded(spark)
    raw = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = raw.withColumn("c", F.when(usable, F.xxhash64("label", "v")))
    known = written(rows.select("vec_id", "c"))
    first = [F.first(x).alias(x) for x in ("label", "v")]
    classes = written(rows.where("c IS NOT NULL").groupBy("c").agg(F.min("vec_id").alias("rep"), F.count("*").alias("k"), *first))
    largest = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, tables = tables_for(largest, cosine)

    def code(batches):
        for b in batches:
            vectors = b.column("v")
            sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                x = flat[(ends[own] - d)[:, None] + np.arange(d)]
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                signs, factor = encode(unit)
                more = [unit @ rotation(d, 1 + r).T > 0 for r in range(-(-bits * tables // d))]
                sides = np.concatenate(more, axis=1)[:, : bits * tables].reshape(len(own), tables, bits)
                keys = sides @ (1 << np.arange(bits))
                at = pa.array(own)
                yield pa.RecordBatch.from_pydict(
                    {
                        "c": b.column("c").take(at),
                        "k": b.column("k").take(at),
                        "label": b.column("label").cast(pa.string()).take(at),
                        "dim": pa.array(np.full(len(own), d, dtype=np.int32)),
                        "unit": pa.array([u.tobytes() for u in unit], pa.binary()),
                        "code": pa.array([s.tobytes() for s in np.packbits(signs, axis=1)], pa.binary()),
                        "factor": pa.array(factor),
                        "keys": pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32())),
                    }
                )

    coded = written(classes.mapInArrow(code, "c long, k long, label string, dim int, unit binary, code binary, factor double, keys array<int>"))
    placed = coded.select("*", F.posexplode("keys").alias("t", "key"))
    parts = placed.groupBy(BUCKET).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block)).drop("n")
    own = F.pmod(F.col("c"), F.col("parts"))
    split = placed.join(parts, BUCKET).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = split.select(*BUCKET, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "c", "k", "unit", "code", "factor", "keys")
    group = [*BUCKET, "lo", "hi"]
    ordered = keyed.repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        held = None
        for b in batches:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if held is not None else b
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows - 1, dtype=bool)
            for g in group:
                col = b.column(g)
                change |= pa.compute.not_equal(col.slice(0, b.num_rows - 1), col.slice(1)).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
            yield from _links(b.slice(0, int(cuts[-1])), cuts, cosine, width)
            held = b.slice(int(cuts[-1]))
        if held is not None:
            yield from _links(held, np.array([0, held.num_rows]), cosine, width)

    links = written(ordered.mapInArrow(compare, "a long, b long, ka long, kb long"))
    found = components(links)
    each = links.select("a", F.col("kb").alias("k")).union(links.select("b", "ka")).groupBy("a").agg(F.sum("k").alias("more"))
    named = found.join(classes.select(F.col("c").alias("node"), "rep"), "node")
    lowest = named.groupBy("component").agg(F.min("rep").alias("lowest"))
    linked = named.join(lowest, "component").select(F.col("node").alias("c"), "lowest")
    of = classes.select("c", "rep", "k").join(linked, "c", "left").join(each.withColumnRenamed("a", "c"), "c", "left")
    of = of.select("c", F.coalesce("lowest", "rep").alias("low"), (F.col("k") - 1 + F.coalesce("more", F.lit(0))).alias("n"))
    out = known.join(of, "c", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(b: pa.RecordBatch, cuts: np.ndarray, cosine: float, width: float):
    """The linked pairs of each group between consecutive cuts; a pair that meets in several tables counts in the first."""
    if not b.num_rows:
        return
    c, k, t, own, lo, hi, dim, factor = (b.column(n).to_numpy(zero_copy_only=False) for n in ("c", "k", "t", "own", "lo", "hi", "dim", "factor"))
    keys = b.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    unit, code = b.column("unit"), b.column("code")
    out = []
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e - s < 2:
            continue
        d = int(dim[s])
        x = np.frombuffer(b"".join(unit.slice(s, e - s).to_pylist()), dtype=np.float64).reshape(-1, d)
        signs = np.unpackbits(np.frombuffer(b"".join(code.slice(s, e - s).to_pylist()), dtype=np.uint8).reshape(e - s, -1), axis=1)[:, :d]
        inner, error = estimate(x, signs, factor[s:e], width)
        may = np.triu(inner + error >= cosine, 1)
        if lo[s] != hi[s]:
            may &= own[s:e][:, None] != own[s:e][None, :]
        i, j = np.nonzero(may)
        if t[s]:
            fresh = (keys[s:e][i, : t[s]] != keys[s:e][j, : t[s]]).all(axis=1)
            i, j = i[fresh], j[fresh]
        good = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[good] + s, j[good] + s
        if len(i):
            out.append((c[i], c[j], k[i], k[j]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "ka", "kb"])
