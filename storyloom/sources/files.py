"""Readers and writers: texts, graph files, chunk tables, results, expectations, gold and version snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.plans.graph import Graph


def read_texts(spark: SparkSession, path: str, work_id: str, source_type: str) -> DataFrame:
    """work_id, source_id (the path), name, source_type, text of whole files in UTF-8, or else CP949."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("cp949", "replace"))

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.regexp_replace(F.col("content").cast("string"), "^﻿", "")).otherwise(decode("content"))
    return raw.select(F.lit(work_id).alias("work_id"), F.col("path").alias("source_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(source_type).alias("source_type"), text.alias("text"))


GRAPH_JSON = """characters array<struct<id:string,name:string,tier:int,description:string,source_id:string>>,
 facts array<struct<id:string,content:string,category:string,importance:string,is_true:string,is_secret:string,source_id:string>>,
 edges array<map<string,string>>"""


def read_graph(spark: SparkSession, path: str, work_id: str) -> Graph:
    """A graph from JSON files of characters, facts and edges; edges without both ends go, missing values take defaults.

    Loose booleans are true or 1 in any case. A character's or fact's place in its file gives its order.
    """
    data = spark.read.schema(GRAPH_JSON).json(path, multiLine=True)
    to_bool = lambda c, d: F.when(c.isNull(), F.lit(d)).otherwise(F.lower(c).isin("true", "1"))
    work = F.lit(work_id).alias("work_id")
    chars = data.select(F.posexplode("characters").alias("seq", "x")).select(work, "seq", "x.id", F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce("x.tier", F.lit(4)).alias("tier"), "x.description", "x.source_id")
    facts = data.select(F.posexplode("facts").alias("seq", "x")).select(work, "seq", "x.id", "x.content", F.coalesce("x.category", F.lit("event_fact")).alias("category"), F.coalesce("x.importance", F.lit("minor")).alias("importance"), to_bool(F.col("x.is_true"), True).alias("is_true"), to_bool(F.col("x.is_secret"), False).alias("is_secret"), "x.source_id", F.round((F.col("seq") + 1) * 0.1, 4).alias("established_order"))
    e = data.select(F.posexplode("edges").alias("seq", "m"))
    get = lambda k: F.nullif(F.element_at("m", k), F.lit(""))
    num = lambda k: F.expr(f"try_cast(element_at(m, '{k}') AS double)")
    e = e.select(
        work, "seq", F.coalesce(get("type"), F.lit("UNKNOWN")).alias("label"), F.coalesce(get("from"), get("from_id")).alias("from_id"), F.coalesce(get("to"), get("to_id")).alias("to_id"),
        num("story_order").alias("story_order"), num("discourse_order").alias("discourse_order"), to_bool(F.element_at("m", "confirmed_intentional"), False).alias("confirmed_intentional"), to_bool(F.element_at("m", "believed_true"), True).alias("believed_true"),
        num("valid_from").alias("valid_from"), num("valid_until").alias("valid_until"), num("intensity").alias("intensity"), *(get(k).alias(k) for k in ("dialogue_text", "via_character", "method", "status_type", "relationship_type", "emotion", "trigger_event_id", "source_id")),
    ).where("from_id IS NOT NULL AND to_id IS NOT NULL")
    labels = {"learns": "LEARNS", "mentions": "MENTIONS", "statuses": "HAS_STATUS", "locations": "AT_LOCATION", "related": "RELATED_TO", "feels": "FEELS", "has_trait": "HAS_TRAIT", "possesses": "POSSESSES", "loses": "LOSES"}
    return Graph.of(spark, characters=chars, facts=facts, **{n: e.where(F.col("label") == v) for n, v in labels.items()})


def time_axes(c) -> tuple:
    """(story offset, linear) by words for before and after in a text."""
    before, after = F.rlike(c, F.lit("전|과거|years ago")), F.rlike(c, F.lit("후|later|며칠 후"))
    return F.when(before, -1.0).when(after, 1.0).otherwise(0.0), ~(before | after)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks as a table by work, with flat fields for search: a row for each chunk, line range as ``a-b``."""
    flat = chunks.select("work_id", "id", "source_id", "chunk_index", "content", "location.source_name", "location.page", "location.chapter", F.concat_ws("-", F.col("location.line_range.start").cast("string"), F.col("location.line_range.end").cast("string")).alias("line_range"))
    flat.write.mode(mode).partitionBy("work_id").parquet(path)


def result_violations(results: DataFrame) -> DataFrame:
    """Saved results (name, details: JSON texts) as rows name, pos, description, is_hard, is_confirmation.

    A detail is a text ``[HARD] (0.98) type: description`` or an object with kind, confidence, type and description.
    """
    d = results.select("name", F.posexplode("details").alias("pos", "raw"))
    o = F.from_json("raw", "kind string, confidence string, type string, description string, desc string, severity string")
    is_object = F.col("raw").startswith("{")
    kind = F.upper(F.coalesce(o["kind"], F.lit("")))
    text = F.when(F.contains("raw", F.lit(": ")), F.expr("substring(raw, locate(': ', raw) + 2)")).otherwise(F.col("raw"))
    return d.select(
        "name", "pos",
        F.when(is_object, F.coalesce(F.nullif(o["description"], F.lit("")), o["desc"], F.lit(""))).otherwise(text).alias("description"),
        F.when(is_object, (kind == "HARD") | (F.coalesce(o["severity"], F.lit("")) == "critical")).otherwise(F.contains("raw", F.lit("[HARD]"))).alias("is_hard"),
        F.when(is_object, kind == "CONF").otherwise(F.contains("raw", F.lit("[CONF]"))).alias("is_confirmation"),
    )


def expectations(files: DataFrame, numbered_only: bool = False) -> DataFrame:
    """Case, idx, description of each line that is not blank (case, text): ``N. text``, or bare and numbered by place. Headings
    count too, unless ``numbered_only``."""
    lines = files.select("case", F.posexplode(F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")).alias("pos", "line"))
    number, rest = (F.regexp_extract("line", r"(?s)^(\d+)\.\s*(.+)", k) for k in (1, 2))
    numbered = number != ""
    out = lines.where(numbered) if numbered_only else lines
    return out.select("case", F.when(numbered, number.cast("int")).otherwise(F.col("pos") + 1).alias("idx"), F.when(numbered, rest).otherwise(F.col("line")).alias("description"))


def read_gold(spark: SparkSession, path: str, categories: dict[str, str], hard_soft: dict[str, str], default: tuple[str, str] = ("timeline", "soft")) -> DataFrame:
    """A row for each contradiction of JSON arrays of cases; codes are looked up, unknown ones take the default."""
    schema = "name string, set string, genre string, contradictions array<struct<id:string,category:string,hard_soft:string,description:string,characters:array<string>,keywords:array<string>>>"
    look = lambda m, c, d: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), c), F.lit(d))
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("name").alias("case"), "set", "genre", F.posexplode("contradictions").alias("seq", "x"))
    return rows.select("case", "set", "genre", "seq", F.col("x.id").alias("gid"), look(categories, F.col("x.category"), default[0]).alias("category"), look(hard_soft, F.col("x.hard_soft"), default[1]).alias("hard_soft"), "x.description", "x.characters", "x.keywords")


def write_gold(gold: DataFrame, path: str) -> None:
    """The gold rows as JSON lines."""
    gold.write.mode("overwrite").json(path)


def write_snapshot(texts: DataFrame, path: str) -> None:
    """Whole texts (source_id, version, text) in folders by source and version."""
    texts.write.mode("append").partitionBy("source_id", "version").parquet(path)


def read_snapshot(spark: SparkSession, path: str, source_id: str, version: str | None = None) -> DataFrame:
    """The texts of a source, or of one version, reading their folders alone."""
    out = spark.read.parquet(path).where(F.col("source_id") == source_id)
    return out if version is None else out.where(F.col("version") == version)
