"""External findings and verdicts (tables of what a reviewer or a model has said) turned into violations, and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators.alike import alike_pairs
from storyloom.operators.components import components
from storyloom.operators.consolidate import batches, display_evidence
from storyloom.operators.firstfit import first_fit
from storyloom.operators.holding import names_in
from storyloom.plans.graph import Graph
from storyloom.plans.numbering import numbered
from storyloom.plans.stored import stored

FINDING = "array<struct<rule_index:int,event_index:int,event_a_index:int,event_b_index:int,description:string,confidence:double,severity:string>>"


def comparison_corpus(g: Graph) -> DataFrame:
    """C4: what events are compared with: facts, ``key=value`` of traits with their owner, and speech with its speaker: work_id, id, content, chunk_id, part, seq."""
    names = g.characters.groupBy("work_id", F.col("id").alias("from_id")).agg(F.max_by("name", "seq").alias("who"))
    facts = g.facts.where("content <> ''").select("work_id", "id", "content", "chunk_id", F.lit(0).alias("part"), "seq")
    owner = g.has_trait.groupBy("work_id", F.col("to_id").alias("id")).agg(F.min_by("from_id", "seq").alias("from_id")).join(names, ["work_id", "from_id"], "left").select("work_id", "id", "who")
    prefix = lambda word: F.when(F.coalesce("who", F.lit("")) != "", F.concat(F.lit("캐릭터 '"), "who", F.lit(f"'의 {word}: "))).otherwise(f"{word}: ")
    traits = g.traits.where("key <> '' AND value <> ''").join(owner, ["work_id", "id"], "left").select("work_id", "id", F.concat(prefix("설정"), "key", F.lit("="), "value"), F.lit(None).cast("string"), F.lit(1), "seq")
    said = g.learns.select("work_id", "from_id", "dialogue_text", "seq", F.lit(2).alias("part")).union(g.mentions.select("work_id", "from_id", "dialogue_text", "seq", F.lit(3)))
    speech = said.where("dialogue_text <> ''").join(names, ["work_id", "from_id"], "left").select("work_id", F.lit("").alias("id"), F.concat(prefix("발언"), "dialogue_text"), F.lit(None).cast("string"), "part", "seq")
    return facts.union(traits).union(speech)


def comparison_batches(g: Graph, most: int = 15_000) -> tuple[DataFrame, DataFrame]:
    """What findings are made of: (corpus with work_id, batch, idx, content, chunk_id; events with work_id, idx, description,
    chunk_id), where indices count from 0, in a batch of the corpus and over a work's events."""
    told = numbered(g.events.where("description <> ''").select("work_id", "id", "description", "chunk_id", "seq"), ["seq", "id"], ["work_id"], "n")
    events = stored(told.select("work_id", (F.col("n") - 1).cast("int").alias("idx"), "description", "chunk_id"))
    corpus = numbered(comparison_corpus(g), ["part", "seq", "id", "content"], ["work_id"], "n")
    rows = corpus.select("work_id", F.col("n").alias("seq"), F.col("content").alias("text"), "chunk_id")
    placed = stored(batches(rows, events.select("work_id", F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), "description").alias("text")), most))
    first = placed.groupBy("work_id", "batch").agg(F.min("seq").alias("first"))
    return stored(placed.join(first, ["work_id", "batch"]).select("work_id", "batch", (F.col("seq") - F.col("first")).cast("int").alias("idx"), F.col("text").alias("content"), "chunk_id")), events


def dedup_findings(findings: DataFrame, least: float = 0.5) -> DataFrame:
    """Findings (work_id, batch, seq, rule, event, description) in order: of those with the same beginnings of rule and event the first,
    and of these each unless it shares more than ``least`` of its Korean words with one kept before."""
    placed = stored(numbered(findings, ["work_id", "batch", "seq"], name="place"))
    pair = placed.where("rule <> '' AND event <> ''").groupBy("work_id", F.substring("rule", 1, 50), F.substring("event", 1, 50)).agg(F.min("place").alias("place")).select("place")
    first = placed.where("NOT coalesce(rule <> '' AND event <> '', false)").unionByName(placed.join(pair, "place", "left_semi").select(placed.columns))
    words = first.select("work_id", "place", F.lit(True).alias("asks"), T.hangul_words("description").alias("words"))
    gone = first_fit(alike_pairs(words, "words", least).where(F.col("score") > least).select("a", "b"))
    return first.join(gone.withColumnRenamed("b", "place"), "place", "left_anti").drop("place")


def _severity(c: Column) -> Column:
    return F.when(c.isin("critical", "major", "minor"), c).otherwise("major")


def world_findings(findings: DataFrame, corpus: DataFrame, events: DataFrame) -> DataFrame:
    """Findings (work_id, batch, items: JSON) as violations. A rule index counts in its batch of the corpus (work_id, batch, idx,
    content, chunk_id); an event index in the work's events (work_id, idx, description, chunk_id), and beyond their number in the batch
    again, which is then a conflict of two rules. Indices out of bounds are left out."""
    x = findings.select("work_id", "batch", F.posexplode(F.from_json("items", FINDING)).alias("seq", "x")).select("work_id", "batch", "seq", "x.*").where("rule_index >= 0 AND event_index >= 0")
    n = events.groupBy("work_id").agg(F.count("*").alias("n"))
    rule = corpus.select("work_id", "batch", F.col("idx").alias("rule_index"), F.col("content").alias("rule"), F.col("chunk_id").alias("rule_chunk"))
    other = corpus.select("work_id", "batch", F.col("idx").alias("event_index"), F.col("content").alias("other"), F.col("chunk_id").alias("other_chunk"))
    ev = events.select("work_id", F.col("idx").alias("event_index"), F.col("description").alias("event"), F.col("chunk_id").alias("event_chunk"))
    j = x.join(n, "work_id", "left").fillna(0, ["n"]).join(rule, ["work_id", "batch", "rule_index"]).join(ev, ["work_id", "event_index"], "left").join(other, ["work_id", "batch", "event_index"], "left")
    rules = F.col("event_index") >= F.col("n")
    j = j.where(F.when(rules, F.col("other").isNotNull()).otherwise(F.col("event").isNotNull()))
    sure, sev = F.coalesce("confidence", F.lit(0.5)), _severity(F.coalesce("severity", F.lit("major")))
    ask = F.when(sev == "critical", sure < 0.85).when(sev == "minor", True).otherwise(sure < 0.8)
    told = F.substring(F.when(rules, F.col("other")).otherwise(F.col("event")), 1, 100)
    return j.select(
        "work_id", "batch", F.col("seq").cast("long").alias("seq"), F.when(rules, "trait").otherwise("timeline").alias("type"), sev.alias("severity"), F.coalesce("description", F.lit("내적 일관성 위반")).alias("description"), sure.alias("confidence"), ask.alias("needs_user_input"),
        F.when(ask, "timeline_ambiguity").alias("confirmation_type"), "rule", told.alias("event"), F.coalesce("rule_chunk", F.when(rules, F.col("other_chunk")).otherwise(F.col("event_chunk"))).alias("chunk_id"), ((sure >= 0.8) & ~ask).alias("is_hard"),
    )


def event_findings(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings on pairs of events (work_id, seq, items: JSON) as violations: each unordered pair once, the first stays."""
    x = findings.select("work_id", "seq", F.posexplode(F.from_json("items", FINDING)).alias("pos", "x")).select("work_id", "seq", "pos", "x.*").where("event_a_index >= 0 AND event_b_index >= 0")
    pair = x.withColumns({"lo": F.least("event_a_index", "event_b_index"), "hi": F.greatest("event_a_index", "event_b_index")})
    ev = events.select("work_id", "idx", F.substring("description", 1, 100).alias("text"), "chunk_id")
    a, b = (ev.select("work_id", F.col("idx").alias(f"event_{s}_index"), F.col("text").alias(f"event_{s}"), F.col("chunk_id").alias(f"chunk_{s}")) for s in "ab")
    j = pair.join(a, ["work_id", "event_a_index"]).join(b, ["work_id", "event_b_index"])
    rest = [c for c in j.columns if c not in ("work_id", "lo", "hi")]
    first = j.groupBy("work_id", "lo", "hi").agg(F.min_by(F.struct(*rest), F.struct("seq", "pos")).alias("r")).select("work_id", "r.*")
    sure = F.coalesce("confidence", F.lit(0.5))
    return first.select("work_id", "seq", F.lit("timeline").alias("type"), _severity(F.coalesce("severity", F.lit("major"))).alias("severity"), F.coalesce(F.nullif("description", F.lit("")), F.lit("이벤트 간 서술 일관성 위반")).alias("description"), sure.alias("confidence"), (sure < 0.8).alias("needs_user_input"), F.when(sure < 0.8, "timeline_ambiguity").alias("confirmation_type"), "event_a", "event_b", F.coalesce("chunk_a", "chunk_b").alias("chunk_id"), (sure >= 0.8).alias("is_hard"))


def _like_texts(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of places of rows (work_id, place, text, asks) of a work with a < b, b asking, of which the shorter text is in
    the longer or shares twenty characters in a row with it. Long texts meet by their windows of twenty characters, shorter ones by
    the index of the texts that hold them."""
    t = rows.where("text <> ''").withColumn("n", F.length("text"))
    windows = t.where("n >= 20").select("work_id", "place", "asks", F.explode(F.expr("array_distinct(transform(sequence(1, n - 19), i -> xxhash64(substring(text, i, 20))))")).alias("h"))
    long = windows.select("work_id", "h", F.col("place").alias("a")).join(windows.where("asks").select("work_id", "h", F.col("place").alias("b")), ["work_id", "h"]).select("a", "b")
    short = t.where("n < 20").select("work_id", F.col("text").alias("name"), F.col("place").alias("s"), F.col("n").alias("n_s"), F.col("asks").alias("asks_s"))
    held = names_in(t.select("work_id", F.col("place").alias("id"), "text"), short)
    inside = held.join(t.select(F.col("place").alias("id"), "n", "asks"), "id").join(short, ["work_id", "name"]).where("n >= n_s AND (asks OR asks_s)")
    either = inside.where("asks_s").select(F.col("id").alias("a"), F.col("s").alias("b")).union(inside.where("asks").select("s", "id"))
    return long.union(either).where("a < b").distinct()


def cross_dedup(existing: DataFrame, findings: DataFrame, alike: float = 0.5, less: float = 0.3, words: int = 3) -> DataFrame:
    """Existing (work_id, id, is_report, description, fact) and findings (work_id, id, seq, is_hard, description, rule) merged: work_id, id, source.

    In order of seq, a finding goes if its rule (over ten characters) is contained in a known fact, contains one or shares twenty
    characters in a row with it, or if its keywords, three or more, are like those of a row kept before. A hard finding
    takes the place of a soft row that it is like by keywords.

    Pairs of like texts and like keywords come from joins; the order matters only within what they connect, so a task
    takes a component of like rows, never a work.
    """
    e = existing.select("work_id", "id", F.lit(0).alias("new"), "seq" if "seq" in existing.columns else F.lit(0).cast("long").alias("seq"), "is_report", F.substring("fact", 1, 60).alias("text"), T.report_keywords("description").alias("kw"))
    f = findings.select("work_id", "id", F.lit(1).alias("new"), "seq", F.col("is_hard").alias("is_report"), F.substring("rule", 1, 60).alias("text"), T.report_keywords("description").alias("kw"))
    rows = numbered(e.unionByName(f), ["work_id", "new", "seq", "id"], name="place")
    told = _like_texts(rows.withColumn("asks", (F.col("new") == 1) & (F.length("text") > 10))).select("a", "b", F.lit(0).alias("kind"))
    sets = rows.select("work_id", "place", (F.col("new") == 1).alias("asks"), "kw")
    scored = alike_pairs(sets, "kw", less).join(rows.select(F.col("place").alias("a"), F.col("kw").alias("ka")), "a").join(rows.select(F.col("place").alias("b"), F.col("kw").alias("kb")), "b")
    close = (F.col("score") > alike) | ((F.col("score") > less) & (F.size(F.array_intersect("ka", "kb")) >= words))
    pairs = stored(told.union(scored.where(close & (F.size("kb") >= words)).select("a", "b", F.lit(1))))
    of = components(pairs.select("a", "b"))
    tied = rows.select("work_id", "id", "place", "new", "is_report", (F.coalesce(F.col("text"), F.lit("")) != "").alias("told")).join(of.withColumnRenamed("node", "place"), "place")
    before = pairs.groupBy(F.col("b").alias("place")).agg(F.collect_list(F.when(F.col("kind") == 0, F.col("a"))).alias("texts"), F.collect_list(F.when(F.col("kind") == 1, F.col("a"))).alias("words"))

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        report: dict[int, bool] = {}  # of the rows kept
        since: dict[int, int] = {}  # their order
        known: set[int] = set()  # rows whose text is a known fact
        for r in df.sort_values("place").itertuples(index=False):
            if r.new:
                if any(x in known for x in (r.texts if r.texts is not None else ())):
                    continue
                like = [x for x in (r.words if r.words is not None else ()) if x in report]
                if like:
                    hit = min(like, key=lambda x: (not report[x], since[x]))
                    if r.is_report and not report[hit]:
                        del report[hit]
                        report[r.place], since[r.place] = True, len(since)
                    continue
            if r.told:
                known.add(r.place)
            report[r.place], since[r.place] = bool(r.is_report), len(since)
        return df[df["place"].isin(list(report))][["work_id", "id", "new"]]

    kept = tied.join(before, "place", "left").groupBy("component").applyInPandas(merge, "work_id string, id string, new int")
    alone = rows.join(of.withColumnRenamed("node", "place"), "place", "left_anti").select("work_id", "id", "new")
    return alone.union(kept).select("work_id", "id", F.when(F.col("new") == 1, "finding").otherwise("rule").alias("source"))


def with_original_text(violations: DataFrame, characters: DataFrame, chunks: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """C11: violations with the text they stand on: that of their own chunk, else of their character's, else the best line (id, line), else dialogue or description.

    chunks: id, content. Texts are joined by chunk id and only for chunks that are named.
    """
    of = characters.where("chunk_id IS NOT NULL").groupBy("work_id", F.col("id").alias("character_id")).agg(F.min_by("chunk_id", "seq").alias("_theirs"))
    v = violations.join(of, ["work_id", "character_id"], "left")
    text = chunks.select(F.col("id").alias("chunk_id"), F.col("content").alias("_own"))
    v = v.join(text, "chunk_id", "left").join(text.toDF("_theirs", "_text"), "_theirs", "left")
    v = v.join(lines.select("id", F.col("line").alias("_line")), "id", "left") if lines is not None else v.withColumn("_line", F.lit(None).cast("string"))
    chunk = F.when(F.col("_own").isNotNull(), F.col("chunk_id")).when(F.col("_text").isNotNull(), F.col("_theirs")).otherwise(F.col("chunk_id"))
    return v.withColumns({"original_text": F.coalesce("_own", "_text", "_line", F.nullif("dialogue", F.lit("")), "description"), "chunk_id": chunk}).drop("_own", "_text", "_theirs", "_line")


def reports(violations: DataFrame, keys: list[str]) -> DataFrame:
    """Violations as report rows: evidence as lines of text by ordered keys, original text before dialogue before description."""
    original = F.coalesce(F.nullif("original_text", F.lit("")), F.nullif("dialogue", F.lit("")), "description") if "original_text" in violations.columns else F.coalesce(F.nullif("dialogue", F.lit("")), "description")
    return violations.select("work_id", "type", "severity", F.when(F.col("is_hard"), "hard").otherwise("soft").alias("hard_or_soft"), "character_id", "character_name", "description", F.transform("evidence", lambda e: display_evidence(e, keys)).alias("evidence"), "confidence", "needs_user_input", original.alias("original_text"), "chunk_id")


def confirmations(violations: DataFrame) -> DataFrame:
    """Violations as pending confirmations; without a type of their own they ask about the timeline."""
    return violations.select("work_id", F.coalesce("confirmation_type", F.lit("timeline_ambiguity")).alias("confirmation_type"), F.lit("pending").alias("status"), F.col("description").alias("question"), F.col("description").alias("context_summary"), F.when(F.col("character_id").isNotNull(), F.array("character_id")).otherwise(F.array().cast("array<string>")).alias("related_entity_ids"), F.col("type").alias("violation_type"))
