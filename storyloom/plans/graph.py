"""The graph as tables: one DataFrame for each vertex and edge label, all keyed by work_id.

Edges have work_id, from_id, to_id, story_order, discourse_order, confirmed_intentional and seq; vertices work_id, id
and seq; both have the columns of their label besides. ``seq`` is the order of insertion, by which ties are broken.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.plans.stored import shared_dir

CHARACTER = "work_id string, id string, name string, aliases array<string>, tier int, description string, source_id string, chunk_id string, seq long"
FACT = "work_id string, id string, content string, category string, importance string, is_true boolean, is_secret boolean, established_order double, source_id string, chunk_id string, seq long"
EVENT = "work_id string, id string, description string, event_type string, story_order double, discourse_order double, is_linear boolean, location string, characters_involved array<string>, source_id string, chunk_id string, seq long"
TRAIT = "work_id string, id string, category string, key string, value string, is_immutable boolean, valid_until timestamp, source_id string, chunk_id string, seq long"
ITEM = "work_id string, id string, name string, is_unique boolean, source_id string, chunk_id string, seq long"
EDGE = "work_id string, from_id string, to_id string, story_order double, discourse_order double, confirmed_intentional boolean, confirmation_id string, source_id string, chunk_id string, dialogue_text string, seq long"
LEARNS = EDGE + ", method string, believed_true boolean, via_character string"
STATUS = EDGE + ", status_type string"
RELATED = EDGE + ", relationship_type string, valid_from double, valid_until double"
VIOLATES = EDGE + ", character_id string, violation string"
FEELS = EDGE + ", emotion string, intensity double, trigger_event_id string"

VERTICES = {"characters": CHARACTER, "facts": FACT, "events": EVENT, "traits": TRAIT, "items": ITEM}
EDGES = {"learns": LEARNS, "mentions": EDGE, "statuses": STATUS, "locations": EDGE, "related": RELATED, "feels": FEELS, "has_trait": EDGE, "violates_trait": VIOLATES, "possesses": EDGE, "loses": EDGE}


@dataclass
class Graph:
    characters: DataFrame
    facts: DataFrame
    events: DataFrame
    traits: DataFrame
    items: DataFrame
    learns: DataFrame
    mentions: DataFrame
    statuses: DataFrame
    locations: DataFrame
    related: DataFrame
    feels: DataFrame
    has_trait: DataFrame
    violates_trait: DataFrame
    possesses: DataFrame
    loses: DataFrame

    @classmethod
    def of(cls, spark, **tables: DataFrame) -> Graph:
        """A graph of the given tables, with missing columns null and missing tables empty."""
        full = {}
        for name, schema in (VERTICES | EDGES).items():
            empty = spark.createDataFrame([], schema)
            full[name] = shaped(tables[name], empty) if name in tables else empty
        return cls(**full)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def shaped(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema))


def union(a: Graph, b: Graph) -> Graph:
    """A canonical graph with a manuscript's on top; nothing is written (an overlay for analysis)."""
    return Graph(**{n: t.unionByName(b.tables()[n]) for n, t in a.tables().items()})


def unmarked(edges: DataFrame) -> DataFrame:
    """Edges that a reviewer has not marked as intended."""
    return edges.where(~F.coalesce("confirmed_intentional", F.lit(False)))


def saved_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as Parquet in the shared folder, so that later steps read them and not all that led to them, and a lost
    executor costs one table at most."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    for name, t in tables.items():
        t.write.parquet(f"{path}/{name}")
    return {name: spark.read.schema(t.schema).parquet(f"{path}/{name}") for name, t in tables.items()}


def saved(g: Graph) -> Graph:
    """The graph over saved tables."""
    return Graph(**saved_tables(g.tables()))
