"""Graph tables derived from the driver's tables, so that every rule runs over data that grows with them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.lexicons import EMOTIONS, RELATIONSHIP_TYPES
from storyloom.plans.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 8).cast("string").alias("work_id"),
        F.col("user_id").cast("string").alias("from_id"),
        k.cast("string").alias("to_id"),
        "event_type",
        "value",
        F.col("event_id").cast("double").alias("story_order"),
        F.datediff("ts", F.lit("2024-01-01")).cast("double").alias("day"),
    )


def event_graph(spark: SparkSession, sf_dir: str, by_day: bool = False) -> Graph:
    """Users as characters, k as facts, places, items and partners. by_day: possession at whole days instead of single events."""
    e = _events(spark, sf_dir)
    of = lambda *kinds: e.where(F.col("event_type").isin(*kinds))
    at_day = lambda d: d.withColumn("story_order", F.col("day"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("seq") % len(values) + 1).cast("int"))
    owned = at_day(of("purchase")) if by_day else of("purchase")
    people = e.groupBy("work_id", F.col("from_id").alias("id")).agg(F.min("seq").alias("seq")).withColumn("name", F.concat(F.lit("U"), "id"))
    facts = e.groupBy("work_id", F.col("to_id").alias("id")).agg(F.min("seq").alias("seq"))
    facts = facts.withColumns({"content": F.concat(F.lit("fact "), "id"), "is_true": F.col("id").cast("long") % 5 != 0})
    items = e.groupBy("work_id", F.col("to_id").alias("id")).agg(F.min("seq").alias("seq")).withColumns({"name": F.concat(F.lit("item "), "id"), "is_unique": F.lit(True)})
    happened = of("click", "view").select("work_id", "seq", "story_order", F.col("seq").cast("string").alias("id"), F.concat(F.lit("event "), "to_id").alias("description"), F.when(F.col("seq") % 97 == 0, "resurrection").otherwise("action").alias("event_type"), F.array(F.concat(F.lit("U"), "from_id")).alias("characters_involved"))
    return Graph.of(
        spark,
        characters=people,
        facts=facts,
        items=items,
        events=happened,
        learns=of("signup").withColumns({"via_character": F.concat(F.lit("U"), "to_id"), "believed_true": F.col("seq") % 3 != 0}),
        mentions=of("view"),
        statuses=of("error").where("value > 40").withColumn("status_type", F.lit("dead")),
        locations=at_day(of("click")),
        related=e.withColumn("relationship_type", pick(RELATIONSHIP_TYPES)),
        feels=e.withColumns({"emotion": pick(EMOTIONS), "discourse_order": F.col("story_order")}),
        possesses=owned,
        loses=at_day(of("error")) if by_day else of("error"),
    )


def trait_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Brands as characters with part types as trait keys and sizes as values."""
    p = read(spark, sf_dir, "part").select(F.lit("0").alias("work_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("from_id"), F.col("p_partkey").cast("string").alias("to_id"), F.col("p_type").alias("key"), F.col("p_size").cast("string").alias("value"), (F.col("p_type") == "ECONOMY").alias("is_immutable"))
    return Graph.of(
        spark,
        characters=p.groupBy("work_id", F.col("from_id").alias("id")).agg(F.min("seq").alias("seq")).withColumn("name", F.col("id")),
        traits=p.withColumn("id", F.col("to_id")),
        has_trait=p,
    )


def number_graph(spark: SparkSession, sf_dir: str, works: int = 500) -> Graph:
    """Parts as facts with a least duration, line items as events with an elapsed time, by work of the part key."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    work = lambda c: (F.col(c) % works).cast("string").alias("work_id")
    facts = part.select(work("p_partkey"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("seq"), F.concat(F.lit("최소 "), F.col("p_size").cast("string"), F.lit("분 소요 "), "p_name").alias("content"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    happened = line.join(part, line.l_partkey == part.p_partkey).select(
        work("l_partkey"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit("분 만에 이동")).alias("description"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("story_order"),
    )
    return Graph.of(spark, facts=facts, events=happened)


def clock_graph(spark: SparkSession, sf_dir: str, works: int = 50) -> Graph:
    """Parts as rules of least durations, two of three about the part; line items as arrivals at clock times."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    work = lambda c: (F.col(c) % works).cast("string").alias("work_id")
    content = F.concat(F.lit("최소 "), F.col("p_size").cast("string"), F.lit("분 소요"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_name")))
    facts = part.select(work("p_partkey"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("seq"), content.alias("content"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    told = F.concat("p_name", F.lit(" "), (F.col("q") % 24).cast("string"), F.lit("시 "), (F.col("l_orderkey") % 60).cast("string"), F.lit("분 도착"))
    happened = line.join(part, line.l_partkey == part.p_partkey).select(work("l_partkey"), seq.cast("string").alias("id"), seq.alias("seq"), told.alias("description"), seq.cast("double").alias("story_order"))
    return Graph.of(spark, facts=facts, events=happened)


def habit_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The event graph with what each user must not touch, one trait for each signup, every other one for good."""
    g = event_graph(spark, sf_dir)
    must_not = g.learns.select("work_id", "seq", "from_id", F.col("seq").cast("string").alias("id"), F.lit("k").alias("key"), F.concat("to_id", F.lit(" 금지")).alias("value"), (F.col("seq") % 2 == 0).alias("is_immutable"))
    new = Graph.of(spark, traits=must_not, has_trait=must_not.withColumn("to_id", F.col("id")))
    return replace(g, traits=new.traits, has_trait=new.has_trait)


def spans_and_probes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Relationships valid for a while, or from then on, and times at which they are asked for, by user."""
    e = _events(spark, sf_dir)
    until = F.when(F.col("seq") % 4 > 0, F.col("story_order") + F.col("seq") % 997)
    spans = e.where("event_type <> 'signup'").select("work_id", "from_id", "to_id", "seq", F.col("story_order").alias("valid_from"), until.alias("valid_until"))
    return spans, e.where("event_type = 'signup'").select("work_id", "from_id", F.col("story_order").alias("time"))
