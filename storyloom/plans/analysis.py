"""The full scan: from chunks to a graph, and from a graph to reports, confirmations and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.consolidate import best_line, consolidate, final_dedup, routed, summary
from storyloom.operators.extract import extract
from storyloom.operators.findings import comparison_batches, confirmations, cross_dedup, dedup_findings, event_findings, reports, with_original_text, world_findings
from storyloom.operators.materialize import conflict_confirmations, materialize
from storyloom.operators.normalize import normalized
from storyloom.operators.review import create_confirmations
from storyloom.operators.rules import scan
from storyloom.plans.graph import Graph, saved, saved_tables
from storyloom.plans.numbering import numbered
from storyloom.plans.stored import stored

#: The keys of evidence that a report line shows, in order.
EVIDENCE_KEYS = ["fact", "trait_key", "trait_value", "compared_text", "location", "item", "relationship_type", "emotion"]


def graph_of_chunks(spark: SparkSession, chunks: DataFrame, existing: Graph | None = None) -> tuple[Graph, DataFrame]:
    """(saved graph, pending confirmations of conflicting sources) of chunks: work_id, chunk_id, source_type, seq, text."""
    n = saved_tables(normalized(saved_tables(extract(chunks))))
    return saved(materialize(spark, n, existing)), create_confirmations(conflict_confirmations(n["conflicts"]))[0]


def full_scan(g: Graph, chunks: DataFrame, verdicts: DataFrame | None = None, world: DataFrame | None = None, pairs: DataFrame | None = None, few: int = 3) -> dict[str, DataFrame]:
    """C14: the whole scan: every rule, consolidated (C1) and routed by verdicts (C2); findings of a reviewer or model about the
    work's rules (C6, C8) and, where the rules found ``few`` violations or fewer, about its events (C7), merged with them (C9); all of
    them de-duplicated once more (C10), with the text they stand on (C11, C12), as ``reports`` and ``confirmations`` (C3) and
    a ``summary`` (C13).

    chunks: work_id, chunk_id, text, seq (their order, if at hand); verdicts: violation_id, confidence; world: work_id, batch, items; pairs:
    work_id, seq, items, both about ``findings.comparison_batches(g)``. A violation's id is made of its content and seq.
    """
    spark = chunks.sparkSession
    found = stored(consolidate(scan(g)).withColumn("id", F.concat(F.lit("violation-"), F.hex(F.xxhash64("work_id", "rule", "type", "description", "character_id", "seq")))))
    empty = spark.createDataFrame([], "violation_id string, confidence double")
    sent = routed(found, verdicts if verdicts is not None else empty)
    sent = stored(numbered(sent, [F.desc("is_hard"), "rule_order", "seq", "id"], ["work_id"], "place"))
    said = _findings(g, sent, world, pairs, few)
    if said is not None:
        fact = F.coalesce(*(F.expr(f"try_element_at(filter(transform(evidence, m -> element_at(m, '{k}')), x -> x IS NOT NULL), 1)") for k in ("fact", "rule")))
        is_report = F.col("route") == "report"
        known = sent.select("work_id", "id", F.col("place").alias("seq"), is_report.alias("is_report"), "description", F.when(is_report, fact).otherwise(F.col("description")).alias("fact"))
        kept = stored(cross_dedup(known, said.select("work_id", "id", F.col("place").alias("seq"), "is_hard", "description", "rule"))).select("work_id", "id")
        sent = sent.unionByName(said.drop("rule", "event"), allowMissingColumns=True).join(kept, ["work_id", "id"], "left_semi")
    sent = stored(sent)
    last = final_dedup(sent.select("work_id", "id", F.col("place").alias("seq"), (F.col("route") == "report").alias("is_report"), F.col("description").alias("text")))
    sent = stored(sent.join(last.select("work_id", "id"), ["work_id", "id"], "left_semi"))
    texts = chunks.select("work_id", F.col("chunk_id").alias("id"), F.col("text").alias("content"), F.col("seq") if "seq" in chunks.columns else F.lit(0).alias("seq"))
    lines = best_line(sent.select("id", "work_id", "description"), texts.select("work_id", "content", "seq")).select("id", "line")
    told = with_original_text(sent, g.characters, texts.select("id", "content"), lines)
    sure = told.withColumn("confidence", F.when(F.col("is_hard"), F.col("confidence")).when(F.col("route") == "report", F.col("verified_confidence")).otherwise(F.col("confidence")))
    return {"reports": reports(sure.where("route = 'report'"), EVIDENCE_KEYS), "confirmations": confirmations(sure.where("route = 'confirmation'")), "summary": summary(sent)}


def _findings(g: Graph, sent: DataFrame, world: DataFrame | None, pairs: DataFrame | None, few: int) -> DataFrame | None:
    """Findings as violations: with place (after all of ``sent``), route, rule and event."""
    if world is None and pairs is None:
        return None
    corpus, events = comparison_batches(g)
    out = []
    if world is not None:
        out.append(dedup_findings(world_findings(world, corpus, events)).withColumn("late", F.lit(0)))
    if pairs is not None:
        many = sent.groupBy("work_id").agg(F.count("*").alias("k")).where(F.col("k") > few).select("work_id")
        e = event_findings(pairs.join(many, "work_id", "left_anti"), events)
        out.append(e.withColumns({"batch": F.lit(0), "rule": F.lit(None).cast("string"), "event": F.concat_ws(" / ", "event_a", "event_b"), "late": F.lit(1)}).drop("event_a", "event_b"))
    new = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    new = numbered(new, ["late", "batch", "seq", "description"], ["work_id"], "nth")
    top = sent.groupBy("work_id").agg(F.max("place").alias("top"))
    evidence = F.array(F.map_filter(F.create_map(F.lit("rule"), F.col("rule"), F.lit("event"), F.col("event")), lambda k, v: v.isNotNull()))
    route = F.when(F.col("is_hard"), "report").otherwise("confirmation")
    new = new.join(top, "work_id", "left").withColumns({
        "place": F.coalesce("top", F.lit(0)) + F.col("nth"), "rule_order": F.lit(None).cast("int"), "evidence": evidence, "route": route, "verified_confidence": F.col("confidence"),
        "id": F.concat(F.lit("finding-"), F.hex(F.xxhash64("work_id", "late", "batch", "seq", "description"))),
    })
    return stored(new.drop("top", "nth", "late", "batch"))
