"""Orders, links and replacement of sources in built graphs, and the ordered first fit under them, against plain loops."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import consolidate, materialize, normalize, rules, versions
from storyloom.operators.alike import alike_pairs, matching_pairs
from storyloom.operators.firstfit import first_fit
from storyloom.plans import analysis
from storyloom.plans.graph import Graph, saved

ONE = "work_id string, source_chunk_id string, seq long, "
SHAPES = {
    "characters": "work_id string, name string, aliases array<string>, seq long, merged_from array<struct<source_chunk_id:string>>",
    "facts": "work_id string, content string, category string, seq long, merged_from array<struct<source_chunk_id:string>>",
    "events": ONE + "description string, location string, event_type string, status_char string, characters_involved array<string>",
    "traits": ONE + "character_name string, key string, value string, category_hint string", "emotions": ONE + "from_char string, to_char string, emotion string",
    "knowledge": ONE + "character_name string, fact_content string, event_type string, method string, via_character string, dialogue_text string",
    "items": ONE + "character_name string, item_name string, action string", "relationships": ONE + "char_a string, char_b string, type_hint string",
}


def tables(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), shape) for n, shape in SHAPES.items()}


def people(*names):
    return [("w", x, [], i, [("k",)]) for i, x in enumerate(names)]


def edge(w, k, seq, who, what, kind):
    return (w, k, seq, who, what, kind, None, None, None)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_first_fit(spark, rounds):
    r = random.Random(rounds)
    pairs = [tuple(sorted(r.sample(range(300), 2))) for _ in range(400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 9), (5, 9), (None, 3), (3, None)]
    gone = set()
    for b in sorted({b for _, b in pairs if b is not None}):
        if any(a not in gone for a, x in pairs if x == b and a is not None):
            gone.add(b)
    got = [x.b for x in first_fit(spark.createDataFrame(pairs, "a long, b long"), rounds).collect()]
    assert sorted(got) == sorted(gone)
    assert first_fit(spark.createDataFrame([], "a long, b long"), rounds).count() == 0


def test_pairs_of_alike_sets_and_texts(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    sets = [(r.choice("ab"), i, i % 3 > 0, [words[min(39, int(r.expovariate(0.15)))] for _ in range(r.randint(0, 9))]) for i in range(200)]
    for least in (0.5, 0.78):
        got = {(x.a, x.b, round(x.score, 9)) for x in alike_pairs(spark.createDataFrame(sets, "work_id string, place long, asks boolean, s array<string>"), "s", least).collect()}
        score = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0
        assert got == {(a[1], b[1], round(score(a[3], b[3]), 9)) for a in sets for b in sets if a[0] == b[0] and a[1] < b[1] and b[2] and score(a[3], b[3]) >= least}
    texts = []
    for i in range(120):
        base = "".join(r.choice("가나다라마바 ") for _ in range(r.choice([4, 8, 11, 30, 90])))
        texts.append(("w", 2 * i, base))
        j = r.randrange(len(base))
        texts.append(("w", 2 * i + 1, base[:j] + r.choice(["", "x", "yz"]) + base[j + r.randint(0, 1) :]))
    texts += [("w", 900, "ab" * 200), ("w", 901, "ab" * 199 + "c"), ("w", 902, "하" * 50), ("w", 903, "하" * 53), ("v", 904, "하" * 52)]
    got = {(x.a, x.b) for x in matching_pairs(spark.createDataFrame(texts, "work_id string, place long, text string")).collect()}
    want = {(a[1], b[1]) for a in texts for b in texts if a[0] == b[0] and a[1] < b[1] and min(len(a[2]), len(b[2])) > 2 and SequenceMatcher(None, b[2], a[2]).ratio() >= 0.9}
    assert {p for p in got} - {p for p in want} == set() and {(a, b) for a, b in want if dict((t[1], t[2]) for t in texts)[a] != dict((t[1], t[2]) for t in texts)[b]} <= got


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def sentences(seed, n):
    r = random.Random(seed)
    parts = [["민수는", "영희는", "철수가"], ["어제", "오늘", "결코", "다시"], ["학교에서", "집에서", "3번 방에서", "5번 방에서"], ["칼을", "편지를", "열쇠를"], ["보았다", "숨겼다", "찾지 않았다", "알고 있다"], [".", "!", "", " "]]
    return [" ".join(r.choice(p) for p in parts[: r.randint(3, 6)]) for _ in range(n)]


def test_merged_facts_equal_the_loop(spark):
    rows = [(w, c, r, f"k{i % 4}", i) for w, seed in (("hot", 1), ("b", 2)) for i, (c, r) in enumerate(zip(sentences(seed, 120 if w == "hot" else 25), ["world_fact", None, "event_fact"] * 40))]
    df = spark.createDataFrame(rows, "work_id string, content string, category_hint string, source_chunk_id string, seq long")
    raw = df.select("work_id", "content", "seq", T.normalize_text("content").alias("norm"), T.semantic_tokens("content").alias("tokens"), T.semantic_tokens("content", True).alias("core"), T.contains_negation("content").alias("neg")).orderBy("seq").collect()
    want = []
    for w in ("hot", "b"):
        heads = []
        for x in (x for x in raw if x.work_id == w):
            for h in heads:
                y = h[0]
                numbers = [set(re.findall(r"\d+", z.content)) for z in (x, y)]
                plain = [{t for t in z.tokens if not re.search(r"\d", t)} for z in (x, y)]
                conflict = (x.neg != y.neg and jac(set(x.core), set(y.core)) >= 0.6) or (all(numbers) and numbers[0] != numbers[1] and jac(*plain) >= 0.6)
                if x.norm == y.norm or not conflict and (SequenceMatcher(None, x.norm, y.norm).ratio() >= 0.9 or jac(set(x.tokens), set(y.tokens)) >= 0.78):
                    h.append(x)
                    break
            else:
                heads.append([x])
        want += [(w, h[0].content, sorted(x.seq for x in h)) for h in heads]
    got = [(r.work_id, r.content, sorted(m.seq for m in r.merged_from)) for r in normalize.merge_facts(df).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(rows)
    assert normalize.merge_facts(df.limit(0)).count() == 0


def test_linked_facts_equal_the_loop(spark):
    facts = [(w, f"f{i}", c, i) for w, s in (("hot", 3), ("b", 4)) for i, c in enumerate(dict.fromkeys(sentences(s, 12)))]
    know = [(w, i + 1, c) for w, s in (("hot", 5), ("b", 6), ("none", 7)) for i, c in enumerate(sentences(s, 90 if w == "hot" else 20))]
    k = spark.createDataFrame(know, "work_id string, k long, fact_content string")
    f = spark.createDataFrame(facts, "work_id string, id string, content string, place long")
    pairs = {r.c: set(r.p) for r in spark.createDataFrame(list({(c,) for *_, c in know} | {(x[2],) for x in facts}), "c string").select("c", T.fact_bigrams("c").alias("p")).collect()}
    want, new = [], {}
    for w in ("hot", "b", "none"):
        known = {c: i for x, i, c, _ in facts if x == w}
        for x, n, c in know:
            if x != w:
                continue
            made = False
            if c not in known:
                score, best = max(((jac(pairs[c], pairs[y]), -j) for j, y in enumerate(known)), default=(0, 0))
                to = known[list(known)[-best]] if score >= 0.5 else None
                if to is None:
                    to, made = f"new {c}", True
                    known[c] = to
            else:
                to = known[c]
            want.append((w, n, to, made))
    got = []
    rows = materialize.link_facts(k, f).collect()
    new = {(r.work_id, r.fact_id): r.content for r in rows if r.is_new}
    for r in rows:
        got.append((r.work_id, r.k, f"new {new[r.work_id, r.fact_id]}" if (r.work_id, r.fact_id) in new else r.fact_id, r.is_new))
    assert sorted(got) == sorted(want) and any(x[3] for x in want) and any(x[2].startswith("f") for x in want)


def test_one_order_runs_over_all_steps(spark):
    """A fact, two scenes, a death, feelings, knowledge with a fact of its own, an item and a relation: tenths in that order."""
    n = tables(
        spark,
        characters=people("민수", "영희"), facts=[("w", "민수가 비밀을 숨겼다", "world_fact", 1, [("k",)])],
        events=[("w", "k", 1, "모두 모였다", "", "scene", None, []), ("w", "k", 2, "문이 닫혔다", "", "scene", None, []), ("w", "k", 101, "민수 사망", "", "death", "민수", ["민수"])],
        emotions=[("w", "k", 1, "영희", "민수", "love")],
        knowledge=[edge("w", "k", 1, "민수", "민수가 비밀을 숨겼다", "mentions"), edge("w", "k", 2, "영희", "열차는 늦게 온다", "learns"), edge("w", "k", 3, "아무도", "모름", "learns")],
        items=[("w", "k", 1, "영희", "칼", "possesses")], relationships=[("w", "k", 1, "민수", "영희", "친구")],
    )
    g = saved(materialize.materialize(spark, n))
    orders = lambda t: [r[0] for r in t.orderBy("discourse_order").select("discourse_order").collect()]
    assert [round(r[0], 4) for r in g.facts.orderBy("established_order").select("established_order").collect()] == [0.1, 0.7]
    assert (orders(g.events), orders(g.feels), orders(g.mentions), orders(g.learns), orders(g.possesses), orders(g.related)) == ([0.2, 0.3, 0.4], [0.5], [0.6], [0.8], [0.9], [1.0])
    assert [(r.type, r.character_name) for r in rules.appears_after_death(g).collect()] == [("timeline", "민수")]
    later = tables(spark, characters=people("민수"), events=[("w", "k2", 1, "비가 왔다", "", "scene", None, [])], knowledge=[edge("w", "k2", 1, "민수", "민수가 비밀을 숨겼어", "learns"), edge("w", "k2", 2, "민수", "민수가 비밀을 숨겼다", "mentions")])
    more = saved(materialize.materialize(spark, later, g))
    assert (orders(more.events), orders(more.learns), orders(more.mentions)) == ([1.1], [1.2], [1.3])
    assert {r.to_id for r in more.learns.union(more.mentions.select(more.mentions.columns).withColumns({"m": F.lit(""), "b": F.lit(True), "v": F.lit("")})).collect()} == {g.facts.where("content LIKE '민수%'").first().id}
    assert more.facts.count() == 0 and more.characters.count() == 0
    assert more.learns.first().from_id == g.characters.where("name = '민수'").first().id


def test_items_become_unique_by_a_later_fact(spark):
    first = saved(materialize.materialize(spark, tables(spark, characters=people("민수"), items=[("w", "k", 1, "민수", "성배", "possesses"), ("w", "k", 2, "민수", "칼", "uses")])))
    assert {r.name: r.is_unique for r in first.items.collect()} == {"성배": False, "칼": False}
    more = materialize.materialize(spark, tables(spark, facts=[("w", "성배는 세상에 하나뿐이다", "world_fact", 1, [("k2",)]), ("v", "칼은 유일하다", "world_fact", 1, [("k2",)])]), first)
    from storyloom.operators.graph_ops import extended

    assert {r.name: r.is_unique for r in extended(first, more).items.collect()} == {"성배": True, "칼": False}


def test_two_sources_of_a_work_in_one_push(spark):
    texts = {"s1": "민수: 열쇠는 서랍 안에 있다.\n민수: 나는 이제 알겠어. 문은 잠겨 있었다.\n", "s2": "영희: 기차는 아홉 시에 떠난다.\n영희: 그래서 범인 이름을 들었다. 그는 의사였다.\n"}
    sources = spark.createDataFrame([("w", "s1", "scenario"), ("w", "s2", "scenario"), ("v", "s3", "scenario")], "work_id string, source_id string, source_type string")
    chunks = lambda *names: spark.createDataFrame([(x, 0, texts[x]) for x in names], "source_id string, chunk_index int, content string")
    old = Graph.of(spark, facts=spark.createDataFrame([("v", "f0", "남는 사실", "s3", 7)], "work_id string, id string, content string, source_id string, seq long"))

    def shown(g):
        names = {r.id: r.name for r in g.characters.collect()}
        facts = {r.id: r.content for r in g.facts.collect()}
        return {(n, names[r.from_id], facts[r.to_id], r.source_id) for n, t in (("learns", g.learns), ("mentions", g.mentions)) for r in t.collect()}

    both = versions.rebuild(old, chunks("s1", "s2"), sources)
    apart = [versions.rebuild(old, chunks(x), sources) for x in ("s1", "s2")]
    assert shown(both) == shown(apart[0]) | shown(apart[1]) and shown(apart[0]) and shown(apart[1])
    assert {r.content for r in both.facts.where("work_id = 'v'").collect()} == {"남는 사실"}
    top = {r.source_id: (r.a, r.b) for r in both.mentions.union(both.learns.select(both.mentions.columns)).groupBy("source_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).collect()}
    assert top["s1"][1] < top["s2"][0]
    again = versions.rebuild(both, chunks("s1"), sources)
    assert shown(again) == shown(both) and again.characters.count() == both.characters.count()
    after = again.mentions.unionByName(again.learns.select(again.mentions.columns)).groupBy("source_id").agg(F.min("discourse_order").alias("a"), F.max("discourse_order").alias("b")).collect()
    after = {r.source_id: (r.a, r.b) for r in after}
    assert after["s1"][0] > after["s2"][1]


def test_best_line_is_of_one_text(spark):
    v = spark.createDataFrame([("v1", "w", "민수는 학교에서 칼을 숨겼다"), ("v2", "w", "영희는 편지를 보았다")], "id string, work_id string, description string")
    three = spark.createDataFrame([("w", "민수는 없다고 했다", 1), ("w", "그 학교에서 만났다", 2), ("w", "그가 칼을 들었다", 3), ("w", "영희는 울며 편지를 썼다\n  영희는 다시 편지를 보았다  \n영희는 편지를 보았다", 4)], "work_id string, content string, seq long")
    assert {r.id: r.line for r in consolidate.best_line(v, three).collect()} == {"v1": None, "v2": "영희는 다시 편지를 보았다"}
