"""Tables written to the folder that all executors share, so that later steps read them and a lost executor costs one table."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a single-machine session gets a temporary folder; a
    cluster raises, as its executors would not see one another's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='storyloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/storyloom"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for p in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query or write are deleted as soon as it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def driver_freed(spark: SparkSession) -> None:
    """Have the driver collect its garbage, and with it shuffle files that nothing refers to: the plans of steps that ended are many times
    what the driver needs, and a heap left alone grows to its limit before they go."""
    gc.collect()
    spark._jvm.System.gc()


def stored_each(spark: SparkSession, tables: Iterable[DataFrame]) -> DataFrame:
    """Tables of the same columns as one Parquet table in the shared folder, read by one scan. Each is written by a job of its own before
    the next is asked for, so that the driver holds the plan and the tasks of one at a time."""
    path, schema = f"{shared_dir(spark)}/{uuid.uuid4().hex}", None
    for df in tables:
        if schema is not None and [(f.name, f.dataType.simpleString()) for f in df.schema] != [(f.name, f.dataType.simpleString()) for f in schema]:
            raise ValueError(f"tables of one store have other columns: {df.schema.simpleString()} and {schema.simpleString()}")
        schema = df.schema if schema is None else schema
        with shuffles_freed(spark):
            df.write.mode("append").parquet(path)
        driver_freed(spark)
    return spark.read.schema(schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is made from; nothing is run."""
    spark, total = df.sparkSession, 0
    for f in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total
