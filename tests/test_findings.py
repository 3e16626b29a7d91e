"""External findings on small tables."""

from storyloom.operators import findings as f
from storyloom.plans.graph import Graph


def test_corpus_names_owners_and_speakers(spark):
    g = Graph.of(
        spark,
        characters=spark.createDataFrame([("w", "a", "민수", 1)], "work_id string, id string, name string, seq long"),
        facts=spark.createDataFrame([("w", "f", "x", 1), ("w", "g", "", 2)], "work_id string, id string, content string, seq long"),
        traits=spark.createDataFrame([("w", "t", "키", "180", 1), ("w", "u", "눈", "갈색", 2)], "work_id string, id string, key string, value string, seq long"),
        has_trait=spark.createDataFrame([("w", "a", "t", 1)], "work_id string, from_id string, to_id string, seq long"),
        mentions=spark.createDataFrame([("w", "a", "f", "안녕", 1)], "work_id string, from_id string, to_id string, dialogue_text string, seq long"),
    )
    assert {r.content for r in f.comparison_corpus(g).collect()} == {"x", "캐릭터 '민수'의 설정: 키=180", "설정: 눈=갈색", "캐릭터 '민수'의 발언: 안녕"}


def test_findings_keep_to_their_bounds(spark):
    items = '[{"rule_index": 0, "event_index": 0, "confidence": 0.9, "severity": "critical", "description": "d"}, {"rule_index": 0, "event_index": 1}, {"rule_index": 5, "event_index": 0}, {"rule_index": 0, "event_index": 9}, {"rule_index": -1, "event_index": 0}]'
    found = spark.createDataFrame([("w", 0, items)], "work_id string, batch int, items string")
    corpus = spark.createDataFrame([("w", 0, 0, "rule", None), ("w", 0, 1, "other", "k")], "work_id string, batch int, idx int, content string, chunk_id string")
    events = spark.createDataFrame([("w", 0, "event", "e")], "work_id string, idx int, description string, chunk_id string")
    got = {r.seq: r for r in f.world_findings(found, corpus, events).collect()}
    assert sorted(got) == [0, 1] and got[0].is_hard and got[0].type == "timeline" and got[0].chunk_id == "e"
    assert got[1].type == "trait" and got[1].event == "other" and got[1].needs_user_input
    pairs = spark.createDataFrame([("w", 1, '[{"event_a_index": 0, "event_b_index": 1, "confidence": 0.9}, {"event_a_index": 1, "event_b_index": 0}]')], "work_id string, seq long, items string")
    events = spark.createDataFrame([("w", 0, "event", "e"), ("w", 1, "event2", None)], "work_id string, idx int, description string, chunk_id string")
    assert [(r.event_a, r.is_hard) for r in f.event_findings(pairs, events).collect()] == [("event", True)]


def test_hard_findings_take_the_place_of_soft_rows(spark):
    old = spark.createDataFrame([("w", "r1", True, "기차역 항구 이동 시간", None), ("w", "c1", False, "민수 커피 혐오 설정 위반", "커피를 마시지 않는다는 설정")], "work_id string, id string, is_report boolean, description string, fact string")
    new = spark.createDataFrame([("w", "n1", 1, True, "민수 커피 혐오 설정 모순", "전혀 다른 규칙에 대한 긴 설명"), ("w", "n2", 2, False, "기차역 항구 이동 거리", "r"), ("w", "n3", 3, False, "별개의 사건", "커피를 마시지 않는다는 설정이다")], "work_id string, id string, seq long, is_hard boolean, description string, rule string")
    assert {(r.id, r.source) for r in f.cross_dedup(old, new).collect()} == {("r1", "rule"), ("n1", "finding")}


def test_original_text(spark):
    v = spark.createDataFrame([("w", "v1", "a", "k1", None, "d"), ("w", "v2", "a", None, None, "d"), ("w", "v3", None, None, None, "d")], "work_id string, id string, character_id string, chunk_id string, dialogue string, description string")
    c = spark.createDataFrame([("w", "a", "k2", 1)], "work_id string, id string, chunk_id string, seq long")
    chunks = spark.createDataFrame([("k1", "one"), ("k2", "two")], "id string, content string")
    assert {r.id: (r.original_text, r.chunk_id) for r in f.with_original_text(v, c, chunks).collect()} == {"v1": ("one", "k1"), "v2": ("two", "k2"), "v3": ("d", None)}
