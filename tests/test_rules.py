"""Rules on small graphs: positive and negative cases, zero orders, ties, nulls and intent marks."""

from storyloom.operators import rules
from storyloom.operators.consolidate import consolidate
from storyloom.plans.graph import Graph

E = "work_id string, from_id string, to_id string, story_order double, seq long"


def graph(spark, **tables):
    return Graph.of(spark, **{n: spark.createDataFrame(rows, schema) for n, (rows, schema) in tables.items()})


def people(*names):
    return [("w", n, n, i) for i, n in enumerate(names)], "work_id string, id string, name string, seq long"


def test_mention_before_learning(spark):
    g = graph(spark, characters=people("A", "B"), learns=([("w", "A", "f", 3.0, 1), ("w", "A", "f", 5.0, 2)], E), mentions=([("w", "A", "f", 2.8, 3), ("w", "A", "f", 4.0, 4), ("w", "A", "f", None, 5), ("w", "B", "f", 1.0, 6), ("x", "A", "f", 0.0, 7)], E))
    got = rules.mention_before_learning(g).collect()
    assert [(r.character_id, r.seq, r.is_hard) for r in got] == [("A", 3, True)]
    assert got[0].description == "캐릭터 'A'이(가) 사실을 알기 전(LEARNS story_order=3.0) 이미 언급(MENTIONS story_order=2.8)"


def test_intent_marks(spark):
    marked = E + ", confirmed_intentional boolean"
    g = graph(spark, characters=people("A"), learns=([("w", "A", "f", 3.0, 1)], E), mentions=([("w", "A", "f", 1.0, 2, True)], marked))
    assert rules.mention_before_learning(g).count() == 0


def test_taught_by_ignorant(spark):
    with_via = E + ", via_character string"
    g = graph(spark, characters=people("A", "B"), learns=([("w", "A", "f", 1.0, 1, "B"), ("w", "A", "f", 1.5, 2, "B"), ("w", "A", "f", 1.0, 3, "A"), ("w", "A", "g", 1.0, 4, "B")], with_via), mentions=([("w", "B", "f", 2.0, 5)], E))
    assert [(r.character_id, r.seq) for r in rules.taught_by_ignorant(g).collect()] == [("A", 1)]


def test_after_death_reports_once_by_source(spark):
    s = E + ", status_type string"
    g = graph(
        spark,
        characters=people("A", "B"),
        statuses=([("w", "A", "e", 9.0, 1, "dead"), ("w", "A", "e", 5.0, 2, "dead"), ("w", "B", "e", 5.0, 3, "dead")], s),
        locations=([("w", "A", "p", 4.0, 4)], E),
        mentions=([("w", "A", "f", 7.0, 5), ("w", "A", "f", 6.0, 6)], E),
        events=([("w", "e1", "B sings", 6.0, 7, ["B", "A"])], "work_id string, id string, description string, story_order double, seq long, characters_involved array<string>"),
    )
    assert [(r.character_id, r.seq) for r in rules.appears_after_death(g).collect()] == [("A", 5)]  # the death written last, 5.0
    assert [r.character_id for r in rules.acts_after_death(g).collect()] == ["B"]


def test_two_places_count_edges_and_places(spark):
    g = graph(spark, characters=people("A"), locations=([("w", "A", "p", 1.0, 1), ("w", "A", "p", 1.0, 2), ("w", "A", "q", 1.0, 3), ("w", "A", "p", 2.0, 4), ("w", "A", "p", 2.0, 5)], E))
    got = rules.two_places(g).collect()
    assert len(got) == 1 and "3개 장소" in got[0].description


def test_relationships(spark):
    s = E + ", relationship_type string"
    rows = [("w", "A", "B", None, 1, "family_parent"), ("w", "B", "A", None, 2, "family_sibling"), ("w", "A", "B", None, 3, "ally"), ("w", "A", "C", None, 4, "colleague"), ("w", "A", "C", None, 5, "family_parent")]
    assert [(r.severity, r.seq) for r in rules.relationship_conflicts(graph(spark, related=(rows, s))).collect()] == [("critical", 1)]


def test_emotions_need_opposites_without_trigger(spark):
    s = "work_id string, from_id string, to_id string, discourse_order double, seq long, emotion string, trigger_event_id string"
    rows = [("w", "A", "B", 1.0, 1, "trust", None), ("w", "A", "B", 2.0, 2, "distrust", None), ("w", "A", "B", 3.0, 3, "trust", "e1"), ("w", "A", "B", 4.0, 4, "hate", None)]
    assert [r.seq for r in rules.emotion_flips(graph(spark, characters=people("A"), feels=(rows, s))).collect()] == [2]


def test_items(spark):
    items = ([("w", "i", "ring", True, 0)], "work_id string, id string, name string, is_unique boolean, seq long")
    g = graph(spark, characters=people("A", "B"), items=items, possesses=([("w", "A", "i", 1.0, 1), ("w", "B", "i", 2.0, 2), ("w", "A", "i", 4.0, 4)], E), loses=([("w", "A", "i", 3.0, 3)], E))
    assert [r.seq for r in rules.repossessions(g).collect()] == [4]
    assert [r.seq for r in rules.unexplained_transfers(g).collect()] == [4]  # B never loses it; A does


def test_numbers(spark):
    facts = ([("w", "f1", "기차역에서 항구까지 최소 12분 소요", 1), ("w", "f2", "항구는 21시 이후 봉쇄", 2), ("w", "f3", "진정제 효과는 최소 30분 이상", 3)], "work_id string, id string, content string, seq long")
    events = ([("w", "e1", "기차역 앞에서 4분 만에 항구 도착", 1.0, 4), ("w", "e2", "항구에 22시에 진입", 2.0, 5), ("w", "e3", "진정제 투여 후 10분 만에 의식 회복", 3.0, 6), ("w", "e4", "기차역에서 4시간 만에 도착", 4.0, 7)], "work_id string, id string, description string, story_order double, seq long")
    got = {(r.evidence[0]["fact_id"], r.severity, r.is_hard) for r in rules.broken_numbers(graph(spark, facts=facts, events=events)).collect()}
    assert got == {("f1", "critical", True), ("f2", "critical", True), ("f3", "major", False)}


def test_clock_minutes_are_no_duration(spark):
    from storyloom.functions.text import fact_constraints, timestamp_minutes

    df = spark.createDataFrame([("22시 18분 이상 걸림",), ("최소 5분",), ("오후 3시 20분",), (None,)], "t string")
    got = df.select(fact_constraints("t").alias("c"), timestamp_minutes("t").alias("m")).collect()
    assert [[(x.kind, x.value) for x in r.c] if r.c else r.c for r in got][:2] == [[], [("min_duration", 5)]]
    assert [r.m for r in got] == [22 * 60 + 18, None, 15 * 60 + 20, None]


def test_prohibitions(spark):
    t = ([("w", "t1", "습관", "커피를 절대 마시지 않는다", True, 1)], "work_id string, id string, key string, value string, is_immutable boolean, seq long")
    events = ([("w", "e1", "A가 커피 두 잔을 마신다", 1.0, 2, ["A"]), ("w", "e2", "A가 커피를 또 마신다", 2.0, 3, ["A"]), ("w", "e3", "B가 커피를 마신다", 3.0, 4, ["B"])], "work_id string, id string, description string, story_order double, seq long, characters_involved array<string>")
    got = rules.broken_prohibitions(graph(spark, characters=people("A", "B"), traits=t, has_trait=([("w", "A", "t1", None, 1)], E), events=events)).collect()
    assert [(r.character_id, r.seq, r.confidence) for r in got] == [("A", 2, 0.85)]


def test_empty_graph_and_order_of_partitions(spark):
    assert rules.scan(Graph.of(spark)).count() == 0
    rows = [("w", "A", f"f{i % 3}", float(9 - i), i) for i in range(9)]
    plain = graph(spark, characters=people("A"), learns=(rows[:4], E), mentions=(rows, E))
    mixed = Graph(**{n: t.repartition(5) for n, t in plain.tables().items()})
    cols = ["description", "seq"]
    assert sorted(map(tuple, consolidate(rules.scan(plain)).select(cols).collect())) == sorted(map(tuple, consolidate(rules.scan(mixed)).select(cols).collect()))


FACTS, EVENTS = "work_id string, id string, content string, seq long", "work_id string, id string, description string, story_order double, seq long"


def test_numbers_of_events_that_share_an_id(spark):
    """Each text holds its own words, and a rule's own fact does not break it, though it is first in every order."""
    facts = ([("w", "f1", "항구까지 최소 12분 소요, 5분 후", 1), ("w", "f2", "등대까지 최소 9분 소요", 2), ("w", "f3", "최소 7 분", 3)], FACTS)
    events = ([("w", "e", "등대를 4분 만에 지나다", 5.0, 5), ("w", "e", "항구를 6분 만에 지나다", 5.0, 5)], EVENTS)
    own = {(r.evidence[0]["fact_id"], r.evidence[0]["compared_text"]) for r in rules.broken_numbers(graph(spark, facts=facts)).collect()}
    assert own == {("f3", "항구까지 최소 12분 소요, 5분 후")}
    got = {(r.evidence[0]["fact_id"], r.evidence[0]["compared_text"]) for r in rules.broken_numbers(graph(spark, facts=facts, events=events)).collect()}
    assert got == {("f1", "항구를 6분 만에 지나다"), ("f2", "등대를 4분 만에 지나다"), ("f3", "등대를 4분 만에 지나다")}


def test_numeric_rules_meet_no_pairs(spark, monkeypatch):
    """As many rules as texts about one place: what is left to choose from grows with the rules, not with their product."""
    n = 60
    facts = ([("w", f"f{i}", f"항구 등대 시장 최소 {i % 7 + 20}분 소요", i) for i in range(n)], FACTS)
    events = ([("w", f"e{i}", f"{i % 3 + 1}시 {i % 59}분 항구, {i % 11 + 15}분 만에 도착", float(i), 1000 + i) for i in range(n)], EVENTS)
    seen, first = [], rules._first
    monkeypatch.setattr(rules, "_first", lambda df, *a: (seen.append(df.count()), first(df, *a))[1])
    g = graph(spark, facts=facts, events=events)
    gaps = {r.evidence[0]["fact_id"]: r.seq for r in rules.broken_gaps(g).collect()}
    numbers = {r.evidence[0]["fact_id"]: r.seq for r in rules.broken_numbers(g).collect()}
    minute = [(i % 3 + 1) * 60 + i % 59 for i in range(n)]
    assert gaps == {f"f{k}": next(1000 + i for i in range(1, n) if 0 < minute[i] - minute[i - 1] < k % 7 + 20) for k in range(n) if any(0 < minute[i] - minute[i - 1] < k % 7 + 20 for i in range(1, n))}
    assert numbers == {f"f{k}": next(1000 + i for i in range(n) if i % 11 + 15 < k % 7 + 20) for k in range(n)}
    assert max(seen) <= 5 * n


def test_prohibitions_of_one_text_meet_once(spark, monkeypatch):
    """Repeated traits and repeated events of a character are one each before they meet; the first of both is reported."""
    n = 30
    t = ([("w", f"t{i}", "습관", "커피 금지", i == 0, i) for i in range(n)], "work_id string, id string, key string, value string, is_immutable boolean, seq long")
    events = ([("w", f"e{i}", "A가 커피를 마신다", float(i), 100 + i, ["A"]) for i in range(n)], "work_id string, id string, description string, story_order double, seq long, characters_involved array<string>")
    seen, first = [], rules._first
    monkeypatch.setattr(rules, "_first", lambda df, *a: (seen.append(df.count()), first(df, *a))[1])
    got = rules.broken_prohibitions(graph(spark, characters=people("A"), traits=t, has_trait=([("w", "A", f"t{i}", None, i) for i in range(n)], E), events=events)).collect()
    assert [(r.character_id, r.seq, r.confidence) for r in got] == [("A", 100, 0.85)] and max(seen) <= n
