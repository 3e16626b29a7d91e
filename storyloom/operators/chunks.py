"""Chunks of texts: overlapping windows of words, with the chapter they stand in. No shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.functions import text as T


def chunk(sources: DataFrame, size: int = 500, overlap: int = 100, shortest: int = 10, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """``sources`` with chunk_index, content and chapter instead of the text, a row for each window.

    Windows of ``size`` words begin every ``size - overlap`` words until one reaches the end. Texts with fewer than ``shortest``
    characters give none, null ones too. The chapter is the last heading seen: in the first 300 characters of the
    text, then in the first 150 of each chunk.
    """
    step = size - overlap
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(r"(\S+)"), 1)
    rows = sources.where(F.length(T.strip(text_col)) >= shortest).withColumns({"_t": tokens, "_seed": T.chapter_marker(F.substring(text_col, 1, 300))}).drop(text_col)
    last = F.greatest(F.lit(0), F.ceil((F.size("_t") - size) / F.lit(step)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_t", i * step + 1, size), " "))
    # the chapter runs through the chunks of one text inside the row, so that no shuffle is needed
    heads = F.transform(parts, lambda c: T.chapter_marker(F.substring(c, F.lit(1), F.lit(150))))
    rows = rows.withColumns({"_c": parts}).withColumn("_h", heads)
    carried = F.transform("_h", lambda h, i: F.coalesce(F.element_at(F.concat(F.array("_seed"), F.filter(F.slice("_h", F.lit(1), i + 1), lambda x: x.isNotNull())), -1), F.col("_seed")))
    return rows.withColumn("_n", carried).select(*[c for c in sources.columns if c != text_col], F.posexplode(F.arrays_zip("_c", "_n")).alias("chunk_index", "_z")).select(*[c for c in sources.columns if c != text_col], "chunk_index", F.col("_z._c").alias("content"), F.col("_z._n").alias("chapter"))


def sections(files: DataFrame) -> DataFrame:
    """The parts of combined files (work_id, name, text) by header lines; text before any header is scenario.

    Rows: work_id, name, source_type, text; a section type that comes again is continued.
    """
    heads = F.create_map(*(F.lit(x) for kv in L.SECTIONS.items() for x in kv))
    lines = files.select("work_id", "name", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line")).withColumn("head", F.element_at(heads, T.strip("line")))
    w = Window.partitionBy("work_id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    typed = lines.withColumn("source_type", F.coalesce(F.last("head", True).over(w), F.lit("scenario"))).where("head IS NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return typed.groupBy("work_id", "name", "source_type").agg(text.alias("text")).withColumn("text", T.strip("text")).where("text <> ''")
