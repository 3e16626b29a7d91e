"""Fixes of texts and their versions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.chunks import chunk
from storyloom.operators.extract import extract
from storyloom.operators.graph_ops import extended, remove_sources
from storyloom.operators.materialize import materialize
from storyloom.operators.normalize import normalized
from storyloom.plans.graph import Graph, saved, saved_tables
from storyloom.plans.stored import stored


def _lines(c):
    return F.regexp_replace(c, "\r\n?", "\n")


def _staged(fixes: DataFrame) -> DataFrame:
    """fixes with a reason why a row is refused, if it is."""
    blank = ~F.coalesce("is_intentional", F.lit(False)) & ((F.coalesce(F.trim("original_text"), F.lit("")) == "") | (F.coalesce(F.trim("fixed_text"), F.lit("")) == ""))
    w = Window.partitionBy("contradiction_id", "_blank").orderBy("staged_at", "original_text", "fixed_text")
    rows = fixes.withColumn("_blank", blank).withColumn("_r", F.row_number().over(w))
    return rows.withColumn("reason", F.when(F.col("_blank"), "blank text").when(F.col("_r") > 1, "already staged")).drop("_blank", "_r")


def staging_queue(fixes: DataFrame) -> DataFrame:
    """V1: the staged fixes, oldest first: texts are not blank unless the fix is an intent, and each contradiction has its first fix."""
    return _staged(fixes).where("reason IS NULL").drop("reason").orderBy("staged_at", "contradiction_id")


def refused_fixes(fixes: DataFrame) -> DataFrame:
    """V1: the fixes that are not staged, with a reason: blank text, or a contradiction that has a fix already."""
    return _staged(fixes).where("reason IS NOT NULL")


def apply_fixes(texts: DataFrame, fixes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """V2: source_id, new_text, applied and failed (contradiction ids in staged order).

    Fixes of a source are applied one after the other, each to the first place of its original text, within its chunk if
    that is given and still found. Line ends become newlines; an intent changes nothing and counts as applied.
    texts: source_id, text; fixes: source_id, contradiction_id, original_text, fixed_text, is_intentional, chunk_id, staged_at; chunks: chunk_id, content.
    """
    f = fixes.join(chunks.select("chunk_id", F.col("content").alias("chunk")), "chunk_id", "left") if chunks is not None else fixes.withColumn("chunk", F.lit(None).cast("string"))
    one = F.struct("staged_at", "contradiction_id", _lines("original_text").alias("old"), F.coalesce("fixed_text", F.lit("")).alias("new"), F.coalesce("is_intentional", F.lit(False)).alias("intent"), _lines("chunk").alias("chunk"))
    todo = f.groupBy("source_id").agg(F.array_sort(F.collect_list(one)).alias("fixes"))
    sql = """aggregate(fixes, named_struct('t', _t, 'applied', cast(array() as array<string>), 'failed', cast(array() as array<string>)), (a, x) ->
      CASE WHEN x.intent THEN named_struct('t', a.t, 'applied', concat(a.applied, array(x.contradiction_id)), 'failed', a.failed)
      WHEN x.old IS NULL OR locate(x.old, a.t) = 0 THEN named_struct('t', a.t, 'applied', a.applied, 'failed', concat(a.failed, array(x.contradiction_id)))
      ELSE named_struct('t', concat(
          substring(a.t, 1, (CASE WHEN coalesce(locate(x.chunk, a.t), 0) > 0 AND locate(x.old, x.chunk) > 0 THEN locate(x.chunk, a.t) + locate(x.old, x.chunk) - 1 ELSE locate(x.old, a.t) END) - 1),
          x.new,
          substring(a.t, (CASE WHEN coalesce(locate(x.chunk, a.t), 0) > 0 AND locate(x.old, x.chunk) > 0 THEN locate(x.chunk, a.t) + locate(x.old, x.chunk) - 1 ELSE locate(x.old, a.t) END) + length(x.old))),
        'applied', concat(a.applied, array(x.contradiction_id)), 'failed', a.failed) END)"""
    out = texts.join(todo, "source_id").withColumn("_t", _lines("text")).withColumn("_r", F.expr(sql))
    return out.select("source_id", F.col("_r.t").alias("new_text"), F.col("_r.applied").alias("applied"), F.col("_r.failed").alias("failed"))


def changed_chunks(chunks: DataFrame, fixes: DataFrame) -> DataFrame:
    """V3: the chunks (source_id, chunk_index, content) that hold a fixed text: none if all fixes of the source are intents, all if none is found."""
    new = fixes.where("NOT coalesce(is_intentional, false) AND fixed_text <> ''").groupBy("source_id").agg(F.collect_set("fixed_text").alias("new"))
    hit = chunks.join(new, "source_id").withColumn("hit", F.exists("new", lambda t: F.contains("content", t)))
    found = hit.groupBy("source_id").agg(F.max("hit").alias("any"))
    return hit.join(found, "source_id").where("hit OR NOT any").select(chunks.columns)


def next_versions(pushes: DataFrame, versions: DataFrame) -> DataFrame:
    """V4: pushes (source_id, seq, fixes_count, description) with the number after the source's last, in order, and a description."""
    last = versions.groupBy("source_id").agg(F.max(F.regexp_extract("version", r"(\d+)", 1).cast("int")).alias("last"))
    w = Window.partitionBy("source_id").orderBy("seq")
    out = pushes.join(last, "source_id", "left").withColumn("_n", F.coalesce("last", F.lit(0)) + F.row_number().over(w))
    text = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.concat(F.col("fixes_count").cast("string"), F.lit("건 수정")))
    return out.withColumns({"version": F.concat(F.lit("v"), F.col("_n").cast("string")), "description": text}).drop("last", "_n")


def list_versions(versions: DataFrame) -> DataFrame:
    """V5: newest first, by number and not by text."""
    return versions.orderBy("source_id", F.desc(F.regexp_extract("version", r"(\d+)", 1).cast("int")))


def diff(a: DataFrame, b: DataFrame, context: int = 3) -> DataFrame:
    """V6: source_id and the unified line difference of two versions' texts (source_id, version, text), empty if they are equal."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        lines = difflib.unified_diff(r.ta.splitlines(keepends=True), r.tb.splitlines(keepends=True), f"{r.source_id}/{r.va}", f"{r.source_id}/{r.vb}", n=context)
        return pd.DataFrame({"source_id": [r.source_id], "diff": ["".join(lines)]})

    both = a.select("source_id", F.col("version").alias("va"), F.col("text").alias("ta")).join(b.select("source_id", F.col("version").alias("vb"), F.col("text").alias("tb")), "source_id")
    return both.groupBy("source_id", "va", "vb").applyInPandas(one, "source_id string, diff string")


def push(texts: DataFrame, fixes: DataFrame, versions: DataFrame, source_chunks=None) -> dict[str, DataFrame]:
    """V4: staged fixes applied to their sources: ``results`` (V2), ``snapshots`` with their version numbers, the ``changed``
    chunks that are to be extracted again, the ``resolved`` contradictions and the ``refused`` fixes. Only sources with
    fixes are read further; a source none of whose fixes is found gets no version."""
    queue = staging_queue(fixes)
    results = apply_fixes(texts, queue, source_chunks)
    applied_any = results.where(F.size("applied") > 0)
    pushes = applied_any.select("source_id", F.lit(1).alias("seq"), F.size("applied").alias("fixes_count"), F.lit("").alias("description"))
    numbered = next_versions(pushes, versions)
    snapshots = applied_any.select("source_id", F.col("new_text").alias("text")).join(numbered.select("source_id", "version", "fixes_count", "description"), "source_id")
    done = results.select("source_id", F.explode("applied").alias("contradiction_id"))
    applied = queue.join(done, ["source_id", "contradiction_id"], "left_semi")
    changed = changed_chunks(chunk(applied_any.select("source_id", F.col("new_text").alias("text"))), applied)
    return {"results": results, "snapshots": snapshots, "changed": changed, "resolved": done, "refused": refused_fixes(fixes)}


def rebuild(g: Graph, changed: DataFrame, sources: DataFrame) -> Graph:
    """V4, M7: the graph after a push. Everything of the sources with changed chunks goes, and what those chunks give by
    extraction, normalisation and materialisation comes in; characters, facts and items that other sources still hold
    keep their ids. A source without a changed chunk is left alone.

    Sources of one work come in one after the other by source_id, each normalised by itself and linked to what the work holds
    by then; the first of all works go together, then the second, so there are as many passes as a work has changed sources.
    What comes in has orders and insertion numbers after all that its work holds.
    changed: source_id, chunk_index, content (from ``push``); sources: work_id, source_id, source_type.
    """
    of = sources.groupBy("source_id").agg(F.min("work_id").alias("work_id"), F.min("source_type").alias("source_type"))
    rows = changed.join(of, "source_id").withColumn("chunk_id", F.concat_ws("#", "source_id", F.col("chunk_index").cast("string")))
    turn = rows.select("work_id", "source_id").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("work_id").orderBy("source_id")))
    rows = stored(rows.join(turn, ["work_id", "source_id"]))
    out = saved(remove_sources(g, rows.select("source_id")))
    for k in range(1, (rows.agg(F.max("turn")).first()[0] or 0) + 1):
        out = saved(_with_sources(out, rows.where(F.col("turn") == k)))
    return out


def _with_sources(g: Graph, rows: DataFrame) -> Graph:
    """The graph with what the chunks of one source of each work give."""
    last = None
    for t in g.tables().values():
        one = t.groupBy("work_id").agg(F.max("seq").alias("s"))
        last = one if last is None else last.union(one)
    after = last.groupBy("work_id").agg((F.floor(F.max("s") / 1000) + 1).cast("long").alias("_after"))
    chunks = rows.join(after, "work_id", "left").select(
        "work_id", "source_id", "chunk_id", F.coalesce("source_type", F.lit("scenario")).alias("source_type"),
        (F.coalesce("_after", F.lit(0)) + F.col("chunk_index")).cast("long").alias("seq"), F.col("content").alias("text"),
    )
    new = materialize(g.characters.sparkSession, saved_tables(normalized(saved_tables(extract(chunks)))), g)
    source = rows.groupBy("work_id").agg(F.min("source_id").alias("_source"))
    return extended(g, Graph(**{n: t.join(source, "work_id", "left").withColumn("source_id", F.coalesce("source_id", "_source")).select(t.columns) for n, t in saved(new).tables().items()}))
