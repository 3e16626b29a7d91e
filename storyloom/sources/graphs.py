"""Graphs kept as tables on disk, one folder for each work, so that a change of a work rewrites that work's files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.review import confirm_nonlinear
from storyloom.plans.graph import EDGES, VERTICES, Graph, saved


def _key(name: str) -> str:
    return "id" if name in VERTICES else "from_id"


def write_graph(g: Graph, path: str) -> None:
    """The graph's tables under ``path``, each with a folder for each work."""
    for name, t in g.tables().items():
        t.repartition("work_id").write.partitionBy("work_id").mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, works: DataFrame | None = None) -> Graph:
    """The graph under ``path``, or of some works (work_id) only, whose folders alone are read."""
    tables = {}
    for name, schema in (VERTICES | EDGES).items():
        t = spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col(_key(name)).isNotNull())
        t = t.join(works.select("work_id").distinct(), "work_id", "left_semi") if works is not None else t
        tables[name] = t.select(*spark.createDataFrame([], schema).columns)
    return Graph(**tables)


def replace_works(g: Graph, path: str, works: DataFrame) -> None:
    """M7, V4: the touched works (work_id) under ``path`` as they are in ``g``, which must not read from ``path``.

    Only the folders of these works are written. A work that a table no longer holds gets a row of nulls there, which takes the
    place of its old files and which no reader sees.
    """
    touched = works.select("work_id").distinct()
    for name, t in g.tables().items():
        rows = t.join(touched, "work_id", "left_semi")
        empty = touched.join(rows.select("work_id").distinct(), "work_id", "left_anti")
        blank = empty.select("work_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema if f.name != "work_id"))
        out = rows.unionByName(blank).repartition("work_id")
        out.write.partitionBy("work_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def confirmed_nonlinear(spark: SparkSession, path: str, answers: DataFrame) -> Graph:
    """The answers (work_id, id, response) to what was asked of flashbacks applied to the kept graph, and the graph of their works,
    over which the rules are to run again. Other works are neither read nor written."""
    works = answers.select("work_id").distinct()
    g = saved(confirm_nonlinear(read_graph(spark, path, works), answers))
    replace_works(g, path, works)
    return g
