"""Review of what the rules could not decide: confirmations, decisions and their effect on the graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators.graph_ops import mark_intentional, remove_sources, resolve_trait_violations
from storyloom.plans.graph import Graph

#: The edges a confirmation marks when it is intended, and the type of the report when it is not.
MARKED_EDGES = {"emotion_shift": ["feels"], "item_discrepancy": ["possesses", "loses"], "relationship_ambiguity": ["related"], "unreliable_narrator": ["learns"], "foreshadowing": ["learns", "mentions"]}
REPORT_TYPE = {
    "flashback_check": "timeline", "timeline_ambiguity": "timeline", "relationship_ambiguity": "relationship", "emotion_shift": "emotion", "item_discrepancy": "item",
    "intentional_change": "trait", "source_conflict": "information_asymmetry", "foreshadowing": "information_asymmetry", "unreliable_narrator": "deception",
}
DECISIONS = ["confirmed_contradiction", "confirmed_intentional", "deferred"]


def create_confirmations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending confirmations, rejected rows): without an excerpt there is nothing to confirm; texts are trimmed, entity ids distinct in order."""
    ok = F.coalesce(F.size("source_excerpts"), F.lit(0)) > 0
    made = rows.where(ok).withColumns({"question": T.strip("question"), "context_summary": T.strip("context_summary"), "related_entity_ids": F.array_distinct("related_entity_ids"), "status": F.lit("pending")})
    return made, rows.where(~ok)


def resolve(confirmations: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: (confirmations with the valid decisions applied, refused decisions with a reason).

    decisions: confirmation_id, decision, user_response, resolved_at, seq; of several for one confirmation the first counts.
    """
    first = decisions.withColumn("ok", F.col("decision").isin(DECISIONS))
    d = first.where("ok").groupBy("confirmation_id").agg(F.min_by(F.struct("decision", "user_response", "resolved_at", "seq"), "seq").alias("d"))
    joined = confirmations.join(d, confirmations["id"] == d["confirmation_id"], "left")
    hit = (F.col("status") == "pending") & F.col("d").isNotNull()
    new = {"status": F.when(hit, F.col("d.decision")).otherwise(F.col("status")), "user_response": F.when(hit, F.col("d.user_response")).otherwise(F.col("user_response")), "resolved_at": F.when(hit, F.col("d.resolved_at")).otherwise(F.col("resolved_at"))}
    applied = joined.withColumns(new).select(confirmations.columns)
    state = first.join(confirmations.select(F.col("id").alias("confirmation_id"), F.col("status").alias("was")), "confirmation_id", "left").join(d.select("confirmation_id", F.col("d.seq").alias("taken")), "confirmation_id", "left")
    reason = F.when(~F.col("ok"), "unknown decision").when(F.col("was").isNull(), "unknown confirmation").when((F.col("was") != "pending") | (F.col("seq") != F.col("taken")), "already resolved")
    return applied, state.withColumn("reason", reason).where("reason IS NOT NULL").select(*decisions.columns, "reason")


def apply_intent(g: Graph, confirmations: DataFrame) -> Graph:
    """The edges of what was confirmed as intended are marked, by confirmation type and related vertices (work_id, id, confirmation_type, related_entity_ids, status)."""
    kinds = F.create_map(*(x for k, v in MARKED_EDGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    done = confirmations.where("status = 'confirmed_intentional'").select("work_id", F.col("id").alias("confirmation_id"), F.explode("related_entity_ids").alias("vid"), F.element_at(kinds, F.col("confirmation_type")).alias("labels"))
    marks = done.select("work_id", F.col("vid").alias("id"), "confirmation_id", F.explode("labels").alias("label"))
    labels = sorted({x for v in MARKED_EDGES.values() for x in v})
    return replace(g, **{n: mark_intentional(g.tables()[n], marks.where(F.col("label") == n)) for n in labels})


def end_traits(g: Graph, changes: DataFrame) -> Graph:
    """Traits whose change is intended are valid until then, and their edges and violations marked. changes: work_id, id, at, confirmation_id."""
    ends = changes.groupBy("work_id", "id").agg(F.min("at").alias("at"))
    traits = g.traits.join(ends, ["work_id", "id"], "left").withColumn("valid_until", F.coalesce("at", "valid_until")).select(g.traits.columns)
    marks = changes.select("work_id", "id", "confirmation_id")
    return resolve_trait_violations(replace(g, traits=traits, has_trait=mark_intentional(g.has_trait, marks)), marks)


def settle_sources(g: Graph, answers: DataFrame, sources: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, sources) after conflicts of sources: those not chosen become inactive and what comes from them goes.

    answers: candidates (source ids), response; an answer that names no candidate changes nothing.
    """
    chosen = answers.withColumn("keep", T.canonical_source("response", "candidates")).where("keep IS NOT NULL")
    off = chosen.select(F.explode(F.array_except("candidates", F.array("keep"))).alias("source_id")).distinct()
    new = sources.join(off.withColumn("_off", F.lit(True)), "source_id", "left").withColumn("status", F.when(F.col("_off"), "inactive").otherwise(F.col("status"))).drop("_off")
    return remove_sources(g, off), new


def confirm_nonlinear(g: Graph, answers: DataFrame) -> Graph:
    """Events that are flashbacks are not linear and take the story order answered, if any. answers: work_id, id, response."""
    a = answers.groupBy("work_id", "id").agg(F.max(T.story_order_of("response")).alias("to"), F.lit(True).alias("hit"))
    e = g.events.join(a, ["work_id", "id"], "left")
    e = e.withColumns({"is_linear": F.when(F.col("hit"), False).otherwise(F.col("is_linear")), "story_order": F.coalesce("to", "story_order")})
    return replace(g, events=e.select(g.events.columns))


def reports_of(confirmations: DataFrame) -> DataFrame:
    """Reports of what was confirmed as a contradiction: certain, major, of the type that belongs to the confirmation."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in REPORT_TYPE.items() for x in kv)), F.col("confirmation_type"))
    done = confirmations.where("status = 'confirmed_contradiction'")
    return done.select("work_id", F.col("id").alias("confirmation_id"), F.coalesce(kind, F.lit("timeline")).alias("type"), F.lit("major").alias("severity"), F.lit(1.0).alias("confidence"), F.col("question").alias("description"), "related_entity_ids")
