"""Fixes that are refused, deaths told by facts, conflicts for review, trait violations and the full scan on small tables."""

from pyspark.sql import functions as F

from storyloom.operators import evaluate, graph_ops, materialize, normalize, review, versions
from storyloom.plans import analysis
from storyloom.plans.graph import Graph

FIX = "source_id string, contradiction_id string, original_text string, fixed_text string, is_intentional boolean, chunk_id string, staged_at long"
SCRIPT = "=== 형사 A (이아름) ===\n혈액형: O형\n소유물: 권총\n상태: 사망\nA: (진술 검토 후) 이제 확실해. 민수가 범인이야.\n민수: 나는 그날 기차역에 없었다.\nA ↔ 민수: 동료 형사\n민수가 칼을 영희에게 건네주었다. 모두가 그 장면을 보았다."


def script(spark, *texts, kind="scenario"):
    rows = [("w", f"s#{i}", "s", kind, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "work_id string, chunk_id string, source_id string, source_type string, seq long, text string")


def test_the_first_fix_of_a_contradiction_stays(spark):
    fixes = spark.createDataFrame([("s", "c", "a", "late", False, None, 2), ("s", "c", "a", "first", False, None, 1), ("s", "c", " ", "x", False, None, 0), ("s", "d", None, None, True, None, 3)], FIX)
    assert [(r.contradiction_id, r.fixed_text) for r in versions.staging_queue(fixes).collect()] == [("c", "first"), ("d", None)]
    assert {(r.staged_at, r.reason) for r in versions.refused_fixes(fixes).collect()} == {(2, "already staged"), (0, "blank text")}


def test_a_fact_of_a_death_names_the_first_character(spark):
    chars = spark.createDataFrame([("w", "c1", "하나", ["지우"], 5), ("w", "c2", "가람", [], 7), ("w", "c3", "", [], 1)], "work_id string, id string, name string, aliases array<string>, seq long")
    facts = spark.createDataFrame([("w", "f1", "가람과 지우는 모두 사망했다", 1), ("w", "f2", "가람은 살아 있다", 2), ("w", "f3", "누군가 죽었다", 3)], "work_id string, id string, content string, seq long")
    assert [(r.fact_id, r.cid, r.name) for r in materialize.named_deaths(facts, chars).collect()] == [("f1", "c1", "하나")]


def test_a_death_told_by_a_fact_is_an_event(spark):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    one = "work_id string, source_chunk_id string, seq long, "
    merged = "merged_from array<struct<source_chunk_id:string>>"
    n = {
        "characters": rows("work_id string, name string, aliases array<string>, seq long, " + merged, ("w", "민수", [], 1, [("k",)])),
        "facts": rows("work_id string, content string, category string, seq long, " + merged, ("w", "민수는 사망했다", "world_fact", 1, [("k",)])),
        "events": rows(one + "description string, location string, event_type string, status_char string, characters_involved array<string>", ("w", "k", 1, "모두 모였다", "", "scene", None, [])),
        "traits": rows(one + "character_name string, key string, value string, category_hint string"), "emotions": rows(one + "from_char string, to_char string, emotion string"),
        "knowledge": rows(one + "character_name string, fact_content string, event_type string, method string, via_character string, dialogue_text string"),
        "items": rows(one + "character_name string, item_name string, action string"), "relationships": rows(one + "char_a string, char_b string, type_hint string"),
    }
    g = materialize.materialize(spark, n)
    death = g.events.where("event_type = 'death'").first()
    assert (death.description, death.characters_involved, death.story_order, death.discourse_order) == ("민수는 사망했다", ["민수"], 0.0, 0.3)
    status = g.statuses.first()
    assert status.to_id == death.id and status.status_type == "dead" and status.from_id == g.characters.first().id


def test_conflicts_of_sources_wait_for_review(spark):
    rows = [("w", "방에는 3 명이 있었다", "k1", 1), ("w", "방에는 5 명이 있었다", "k2", 2)]
    facts = spark.createDataFrame(rows, "work_id string, content string, source_chunk_id string, seq long")
    made, refused = review.create_confirmations(materialize.conflict_confirmations(normalize.source_conflicts(facts)))
    r = made.first()
    assert made.count() == 1 and refused.count() == 0 and (r.status, r.confirmation_type) == ("pending", "source_conflict")
    assert r.context_summary == "충돌 값: 방에는 3 명이 있었다, 방에는 5 명이 있었다" and r.question.startswith("소스 충돌: 'fact:")
    assert [(x.source_name, x.text) for x in r.source_excerpts] == [("k1", rows[0][1]), ("k2", rows[1][1])]


def test_trait_violations_are_marked(spark):
    edges = spark.createDataFrame([("w", "e1", "t1", 1), ("w", "t1", "t2", 2), ("v", "e1", "t1", 3)], "work_id string, from_id string, to_id string, seq long")
    marks = spark.createDataFrame([("w", "t1", "c9")], "work_id string, id string, confirmation_id string")
    got = graph_ops.resolve_trait_violations(Graph.of(spark, violates_trait=edges), marks).violates_trait
    assert {(r.seq, r.confirmed_intentional, r.confirmation_id) for r in got.collect()} == {(1, True, "c9"), (2, None, None), (3, None, None)}


def test_counts_of_what_a_removal_takes(spark):
    facts = spark.createDataFrame([("w", "f1", "s1", 1), ("w", "f2", "s2", 2)], "work_id string, id string, source_id string, seq long")
    chars = spark.createDataFrame([("w", "A", "s2", 1)], "work_id string, id string, source_id string, seq long")
    learns = spark.createDataFrame([("w", "A", "f1", 1), ("w", "A", "f2", 2)], "work_id string, from_id string, to_id string, seq long")
    g = Graph.of(spark, characters=chars, facts=facts, learns=learns)
    left = graph_ops.remove_sources(g, spark.createDataFrame([("s1",)], "source_id string"))
    assert [tuple(r) for r in graph_ops.removed_counts(g, left).collect()] == [("w", 1, 1)]


def test_relation_recall(spark):
    found = spark.createDataFrame([("x", "김민수", "이영희"), ("x", "철수", "영희")], "case string, char_a string, char_b string")
    gold = spark.createDataFrame([("x", "민수", "영희"), ("x", "영희", "민수"), ("y", "a", "b")], "case string, char_a string, char_b string")
    assert {r.case: r.relation_recall for r in evaluate.relation_recall(found, gold).collect()} == {"x": 0.5, "y": 0.0}


def test_full_scan_from_chunks(spark):
    c = script(spark, SCRIPT, "민수: 나는 다시 왔다. 형사는 사망했다고 들었다.\nA: 나는 여기 있다. 그 사실은 이미 알고 있다.")
    g, waiting = analysis.graph_of_chunks(spark, c)
    out = analysis.full_scan(g, c)
    n = out["reports"].count() + out["confirmations"].count()
    total = {(r.facet, r.value): r.total for r in out["summary"].collect()}
    assert n == total["all", "all"] == total["hard_soft", "hard"] + total.get(("hard_soft", "soft"), 0) and n > 0
    assert out["reports"].where("hard_or_soft = 'soft'").count() == 0
    assert out["reports"].where("original_text IS NULL OR original_text = ''").count() == 0 and waiting.count() >= 0


def test_push_and_rebuild(spark):
    old = "첫째 문장은 바뀐다. 민수: 나는 집에 있었다."
    texts = spark.createDataFrame([("s", old), ("t", "다른 글은 그대로 남는다")], "source_id string, text string")
    fixes = spark.createDataFrame([("s", "c1", "집에 있었다", "역에 있었다", False, None, 1), ("t", "c2", "없는 글", "x", False, None, 2)], FIX)
    out = versions.push(texts, fixes, spark.createDataFrame([], "source_id string, version string"))
    assert [(r.source_id, r.version) for r in out["snapshots"].collect()] == [("s", "v1")]
    facts = spark.createDataFrame([("w", "f1", "낡은 사실", "s", 1), ("w", "f2", "남는 사실", "t", 2)], "work_id string, id string, content string, source_id string, seq long")
    sources = spark.createDataFrame([("w", "s", "settings"), ("w", "t", "settings")], "work_id string, source_id string, source_type string")
    g = versions.rebuild(Graph.of(spark, facts=facts), out["changed"], sources)
    rows = {r.content: r.source_id for r in g.facts.collect()}
    assert rows["남는 사실"] == "t" and "낡은 사실" not in rows
    assert any("역에 있었다" in x and s == "s" for x, s in rows.items())
    assert g.events.where(F.col("source_id") == "s").count() > 0
