"""Review, versions, chunks, extraction, sources and evaluation on small tables."""

from storyloom.functions import text as T
from storyloom.operators import chunks, evaluate, extract, graph_ops, normalize, review, versions
from storyloom.plans.graph import Graph
from storyloom.sources import files


def test_fixes_in_order_and_in_their_chunk(spark):
    texts = spark.createDataFrame([("s", "one two\r\ntwo three two")], "source_id string, text string")
    schema = "source_id string, contradiction_id string, original_text string, fixed_text string, is_intentional boolean, chunk_id string, staged_at long"
    fixes = spark.createDataFrame([("s", "c1", "two", "2", False, "k", 1), ("s", "c2", "nine", "9", False, None, 2), ("s", "c3", "one", None, True, None, 3), ("s", "c4", "two", "zwei", False, None, 4)], schema)
    where = spark.createDataFrame([("k", "two three two")], "chunk_id string, content string")
    r = versions.apply_fixes(texts, fixes, where).first()
    assert r.new_text == "one zwei\n2 three two" and r.applied == ["c1", "c3", "c4"] and r.failed == ["c2"]


def test_versions_and_diff(spark):
    v = spark.createDataFrame([("s", "v2"), ("s", "v10"), ("s", "v1")], "source_id string, version string")
    assert [r.version for r in versions.list_versions(v).collect()] == ["v10", "v2", "v1"]
    p = spark.createDataFrame([("s", 1, 2, ""), ("t", 1, 1, "x")], "source_id string, seq long, fixes_count int, description string")
    assert {(r.source_id, r.version, r.description) for r in versions.next_versions(p, v).collect()} == {("s", "v11", "2건 수정"), ("t", "v1", "x")}
    a, b = (spark.createDataFrame([("s", n, t)], "source_id string, version string, text string") for n, t in (("v1", "x\ny\n"), ("v2", "x\nz\n")))
    assert versions.diff(a, b).first()["diff"].splitlines()[-2:] == ["-y", "+z"]
    assert versions.diff(a, a).first()["diff"] == ""


def test_decisions(spark):
    c = spark.createDataFrame([("w", "c1", "emotion_shift", "pending", None, None, ["A"]), ("w", "c2", "emotion_shift", "deferred", None, None, [])], "work_id string, id string, confirmation_type string, status string, user_response string, resolved_at string, related_entity_ids array<string>")
    d = spark.createDataFrame([("c1", "confirmed_intentional", "ok", "t", 1), ("c1", "deferred", "", "t", 2), ("c2", "deferred", "", "t", 3), ("c3", "deferred", "", "t", 4), ("c1", "maybe", "", "t", 5)], "confirmation_id string, decision string, user_response string, resolved_at string, seq long")
    done, refused = review.resolve(c, d)
    assert {(r.id, r.status) for r in done.collect()} == {("c1", "confirmed_intentional"), ("c2", "deferred")}
    assert {(r.seq, r.reason) for r in refused.collect()} == {(2, "already resolved"), (3, "already resolved"), (4, "unknown confirmation"), (5, "unknown decision")}
    feels = spark.createDataFrame([("w", "A", "B", 1), ("w", "B", "C", 2)], "work_id string, from_id string, to_id string, seq long")
    g = review.apply_intent(Graph.of(spark, feels=feels), done)
    assert {(r.seq, r.confirmed_intentional) for r in g.feels.collect()} == {(1, True), (2, None)}


def test_chunks_overlap_and_carry_the_chapter(spark):
    words = " ".join(f"w{i}" for i in range(897))
    df = spark.createDataFrame([("a", f"# Chapter 3\n{words}"), ("b", "short"), ("c", None), ("d", "just long enough")], "source_id string, text string")
    got = {(r.source_id, r.chunk_index): r for r in chunks.chunk(df).collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("d", 0)]
    assert got["a", 1].content.split()[0] == "w397" and got["a", 1].chapter == "# Chapter 3" and got["d", 0].chapter is None


def test_sections(spark):
    df = spark.createDataFrame([("w", "f", "x\n[세계관]\na\nb\n[설정집]\nc\n[세계관]\nd")], "work_id string, name string, text string")
    assert {r.source_type: r.text for r in chunks.sections(df).collect()} == {"scenario": "x", "worldview": "a\nb\nd", "settings": "c"}


def test_extraction(spark):
    text = "=== 형사 A (이아름) ===\n혈액형: O형\n소유물: 권총 (38구경)\n민수에 대해: 불신\n상태: 사망\nA: (진술 검토 후) 이제 확실해. 민수가 범인이야.\n민수: 나는 그날 기차역에 없었다.\nA ↔ 민수: 동료 형사\n민수가 칼을 영희에게 건네주었다. 모두가 그 장면을 보았다."
    c = spark.createDataFrame([("w", "k", "scenario", 1, text), ("w", "e", "scenario", 2, "")], "work_id string, chunk_id string, source_type string, seq long, text string")
    got = extract.extract(c)
    assert {"A", "민수"} <= {r.name for r in got["characters"].collect()}
    assert {(r.character_name, r.key, r.value) for r in got["traits"].collect()} >= {("A", "혈액형", "O형")}
    assert ("A", "민수", "distrust") in {(r.from_char, r.to_char, r.emotion) for r in got["emotions"].collect()}
    assert ("A", "민수", "colleague") in {(r.char_a, r.char_b, r.type_hint) for r in got["relationships"].collect()}
    know = {(r.character_name, r.event_type): r.fact_content for r in got["knowledge"].collect()}
    assert know["A", "learns"] == "민수가 범인이야." and know["민수", "mentions"].startswith("나는")
    assert {("A", "권총", "possesses"), ("민수", "칼", "loses"), ("영희", "칼", "possesses")} <= {(r.character_name, r.item_name, r.action) for r in got["items"].collect()}
    assert "A" in {r.status_char for r in got["events"].collect()}
    assert [r.chunk_id for r in got["empty"].collect()] == ["e"]


def test_fact_merge(spark):
    rows = [("w", "민수는 어제 기차역에서 범인을 보았다", 1), ("w", "민수는 어제 기차역에서 범인을 보았다.", 2), ("w", "민수는 어제 기차역에서 범인을 못 보았다", 3), ("w", "방에는 3 명이 있었다", 4), ("w", "방에는 5 명이 있었다", 5)]
    df = spark.createDataFrame(rows, "work_id string, content string, seq long").selectExpr("*", "'world_fact' AS category_hint", "cast(seq as string) AS source_chunk_id")
    got = {r.seq: len(r.merged_from) for r in normalize.merge_facts(df).collect()}
    assert got == {1: 2, 3: 1, 4: 1, 5: 1}
    assert normalize.source_conflicts(df).count() == 2


def test_names(spark):
    df = spark.createDataFrame([("w", "Kim Min", "a", 1), ("w", "kimmin", "b", 2), ("w", "Lee", "c", 3)], "work_id string, name string, source_chunk_id string, seq long")
    assert {(r.name, tuple(r.aliases)) for r in normalize.characters(df).collect()} == {("Kim Min", ("kimmin",)), ("Lee", ())}


def test_matching_is_one_to_one(spark):
    v = spark.createDataFrame([("c", "v1", 1, "knife in the room", True), ("c", "v2", 2, "knife", False)], "case string, vid string, seq long, text string, is_hard boolean")
    g = spark.createDataFrame([("c", "g1", 1, ["knife"], "item", "hard"), ("c", "g2", 2, ["knife", "room"], "item", "hard"), ("c", "g3", 3, [], "item", "soft")], "case string, gid string, seq long, keywords array<string>, category string, hard_soft string")
    a = evaluate.assign(v, g)
    assert {(r.gid, r.vid) for r in a.collect()} == {("g1", "v1"), ("g2", "v2"), ("g3", None)}
    s = evaluate.scores(evaluate.counts(a, v, spark.createDataFrame([("c", "s")], "case string, set string"))).first()
    assert (s.tp, s.fp, s.fn) == (2, 0, 1) and s.precision == 1.0


def test_results_and_expectations(spark):
    r = spark.createDataFrame([("x", ["[HARD] (0.98) timeline: late: again", '{"kind": "conf", "desc": "d"}'])], "name string, details array<string>")
    assert [(x.description, x.is_hard, x.is_confirmation) for x in files.result_violations(r).orderBy("pos").collect()] == [("late: again", True, False), ("d", False, True)]
    e = spark.createDataFrame([("x", "Heading\n\n2. second\n")], "case string, text string")
    assert [(x.idx, x.description) for x in files.expectations(e).collect()] == [(1, "Heading"), (2, "second")]


def test_text_functions(spark):
    df = spark.createDataFrame([("친구 사이", "canonical:b", "story_order:2.5"), (None, "a", "none")], "rel string, resp string, ord string")
    from pyspark.sql import functions as F

    got = df.select(T.relationship_type("rel"), T.canonical_source("resp", F.array(F.lit("a"), F.lit("b"))), T.story_order_of("ord")).collect()
    assert [tuple(r) for r in got] == [("friend", "b", 2.5), ("colleague", "a", None)]


def test_source_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("민수".encode("cp949"))
    (tmp_path / "b.txt").write_bytes("영희".encode())
    assert {r.name: r.text for r in files.read_texts(spark, str(tmp_path / "*.txt"), "w", "scenario").collect()} == {"a.txt": "민수", "b.txt": "영희"}
    (tmp_path / "g.json").write_text('{"characters": [{"id": "c1", "name": "A"}], "facts": [{"id": "f1", "content": "x", "is_true": "False"}], "edges": [{"type": "LEARNS", "from": "c1", "to": "f1", "story_order": 1.0}, {"type": "LEARNS", "from": "c1"}]}')
    g = files.read_graph(spark, str(tmp_path / "g.json"), "w")
    assert g.learns.count() == 1 and not g.facts.first().is_true


def test_removing_a_source_leaves_no_dangling_edge(spark):
    facts = spark.createDataFrame([("w", "f1", "s1", 1), ("w", "f2", "s2", 2)], "work_id string, id string, source_id string, seq long")
    chars = spark.createDataFrame([("w", "A", "s2", 1)], "work_id string, id string, source_id string, seq long")
    learns = spark.createDataFrame([("w", "A", "f1", 1), ("w", "A", "f2", 2)], "work_id string, from_id string, to_id string, seq long")
    left = graph_ops.remove_sources(Graph.of(spark, characters=chars, facts=facts, learns=learns), spark.createDataFrame([("s1",)], "source_id string"))
    assert [r.to_id for r in left.learns.collect()] == ["f2"]


def test_gold_annotations(spark):
    df = spark.createDataFrame([("x", 1, "민수는 사망 후 재등장한다"), ("x", 2, "도보로 12분 거리를 \u201c4분 만에 이동\u201d 했다"), ("x", 3, "머리 색이 바뀐다")], "case string, idx int, description string")
    got = {r.gid: r for r in evaluate.gold_annotations(df).collect()}
    assert [(got[k].category, got[k].hard_soft) for k in ("x-1", "x-2", "x-3")] == [("DEATH_REAPPEAR", "hard"), ("TIMELINE_MOVE", "soft"), ("TRAIT_SETTING", "soft")]
    assert got["x-1"].keywords == ["사망", "재등장"] and "민수" in got["x-1"].characters
    assert got["x-2"].keywords[:4] == ["4분", "만에", "이동", "12분"]


def test_push_reaches_only_changed_chunks(spark):
    texts = spark.createDataFrame([("s", " ".join(f"w{i}" for i in range(1200))), ("t", "nothing to fix here")], "source_id string, text string")
    schema = "source_id string, contradiction_id string, original_text string, fixed_text string, is_intentional boolean, chunk_id string, staged_at long"
    fixes = spark.createDataFrame([("s", "c1", "w1100 ", "fixed ", False, None, 1), ("s", "c1", " ", "x", False, None, 2)], schema)
    out = versions.push(texts, fixes, spark.createDataFrame([("s", "v3")], "source_id string, version string"))
    assert [(r.source_id, r.version, r.fixes_count) for r in out["snapshots"].collect()] == [("s", "v4", 1)]
    assert [r.chunk_index for r in out["changed"].collect()] == [2] and [r.contradiction_id for r in out["resolved"].collect()] == ["c1"]
