"""Extraction: a text without a word of a rule is not searched for it, and what is found stays the same."""

from storyloom.functions import text as T
from storyloom.operators import extract

CHUNK = "work_id string, chunk_id string, source_type string, seq long, text string"
TEXTS = [
    "=== 민수 ===\n특성: 커피 혐오\n소유물: 열쇠\n상태: 사망\n영희에 대해: 신뢰\n민수 ↔ 영희: 동료",
    "민수: 영희를 사랑해.\n영희: 나는 이제 알겠어 그 비밀을.\n민수가 칼을 꺼냈다. 민수가 비밀을 모두 다 알았다고 말했다 알았다",
    "민수가 열쇠를 영희에게 건네주었다. 철수와 영희는 부부 사이였다. 철수가 말했다.",
    "User: Nothing of this is here.\nAssistant: Nor here at all.",
    None,
]


def test_every_kind(spark):
    c = spark.createDataFrame([("w", f"c{i}", "scenario", i, t) for i, t in enumerate(TEXTS)], CHUNK)
    got = {kind: rows.collect() for kind, rows in extract.extract(c).items()}
    assert [(r.character_name, r.key, r.value) for r in got["traits"]] == [("민수", "커피", "혐오")]
    assert {(r.from_char, r.to_char, r.emotion) for r in got["emotions"]} == {("민수", "영희", "trust"), ("민수", "영희", "love")}
    assert {(r.char_a, r.char_b, r.type_hint) for r in got["relationships"]} == {("민수", "영희", "colleague"), ("철수", "영희", "family_spouse")}
    assert {("민수", "열쇠", "possesses"), ("민수", "열쇠", "loses"), ("영희", "열쇠", "possesses"), ("민수", "칼", "uses")} <= {(r.character_name, r.item_name, r.action) for r in got["items"]}
    assert {("영희", "learns"), ("민수", "learns")} <= {(r.character_name, r.event_type) for r in got["knowledge"]}
    assert {"User", "Assistant", "민수", "영희", "철수"} <= {r.name for r in got["characters"]}


def test_verbs_that_the_text_lacks_are_left_out(spark):
    held = spark.createDataFrame([("민수가 알았다",), ("plain",), (None,)], "text string").select(extract._holds(T._col("text"), extract.F.array(*map(extract.F.lit, extract.LEARN_VERBS))).alias("v"))
    assert [r.v for r in held.collect()] == [["알았다"], [], []]


def test_words_of_normal_text_are_those_of_the_text(spark):
    df = spark.createDataFrame([("  민수는 안 왔다, 비밀을 모른다! ",), ("",), ("not A b",)], "t string").withColumn("n", T.normalize_text("t"))
    same = df.select((T.semantic_tokens("t") == T.normal_tokens("n")).alias("a"), (T.semantic_tokens("t", True) == T.without_negations(T.normal_tokens("n"))).alias("b"), (T.contains_negation("t") == T.normal_negation("n")).alias("c"))
    assert all(r.a and r.b and r.c for r in same.collect())
