"""Helpers that several operators use: written tables, text columns, fixed-size vector sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='storyloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/storyloom"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing reads any more."""
    spark = df.sparkSession
    paths = {f.rpartition("/")[0] for f in df.inputFiles()}
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; other columns never travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounded(spark: SparkSession, size: int = 8 << 20) -> None:
    """Batches to Python end at ``size`` bytes too, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


VECTOR = "slot int, kind string, places binary, counts binary"


def vector_rows(vector: np.ndarray, width: int = 4096):
    """A task's count vector as rows of VECTOR: slices of ``width`` counts in the narrowest type, sparse where that is shorter."""
    grid = vector.reshape(-1, width)
    out: list[tuple] = []
    for slot in np.flatnonzero(grid.any(axis=1)):
        v = grid[slot]
        kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if v.max() <= np.iinfo(k).max)
        used = np.flatnonzero(v)
        size = np.dtype(kind).itemsize
        if len(used) * (2 + size) < width * size:
            out.append((int(slot), kind, used.astype("<u2").tobytes(), v[used].astype(kind).tobytes()))
        else:
            out.append((int(slot), kind, b"", v.astype(kind).tobytes()))
        if len(out) == 256:
            yield _vector_batch(out)
            out = []
    if out:
        yield _vector_batch(out)


def _vector_batch(rows: list[tuple]) -> pa.RecordBatch:
    slot, kind, places, counts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["slot", "kind", "places", "counts"])


def vector_sum(parts: DataFrame, size: int, width: int = 4096) -> np.ndarray:
    """The sum of the tasks' count vectors, on the driver. Its ``size`` is a parameter of the operator, not of the data.

    Each reducing task adds up what it reads batch by batch, so it holds one slice for each of its slots however many
    tasks contributed to them.
    """

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, kind, places, counts in zip(*(c.to_pylist() for c in b.columns)):
                v = total.setdefault(slot, np.zeros(width, dtype=np.int64))
                c = np.frombuffer(counts, dtype=kind)
                if places:
                    v[np.frombuffer(places, dtype="<u2")] += c
                else:
                    v += c
        for slot, v in total.items():
            yield _vector_batch([(slot, "<i8", b"", v.tobytes())])

    out = np.zeros((size // width, width), dtype=np.int64)
    for r in parts.repartition("slot").mapInArrow(add, VECTOR).toLocalIterator():
        out[r[0]] = np.frombuffer(bytes(r[3]), dtype="<i8")
    return out.reshape(-1)
