"""The whole scan against loops over the rules' rows, and rules over texts and intervals against plain searches."""

import json
import random

from pyspark.sql import functions as F
from test_consolidation import covered, jac

from storyloom.functions import text as T
from storyloom.operators import findings, materialize, rules
from storyloom.operators.holding import names_in
from storyloom.plans import analysis, bindings
from storyloom.plans.graph import Graph, saved

SF = "/root/testdata/sf0.001"
SUBJECTS = ["민수가 열쇠를", "영희가 편지를", "철수가 기차를", "모두가 비밀을"]
VERBS = ["숨겼다는 설정 위반", "보았다는 시간 모순", "잃었다는 관계 위반", "다시 찾았다는 규칙 모순"]


def like(short, long):
    return short in long or any(short[i : i + 20] in long for i in range(len(short) - 19))


def merged(known, new, keywords):
    """C9 as one loop over a work: known and new rows as dicts in order."""
    facts = [k["fact"][:60] for k in known if k["fact"]]
    reports, asked = [k for k in known if k["is_report"]], [k for k in known if not k["is_report"]]
    for v in new:
        rule, kw = (v["rule"] or "")[:60], keywords[v["description"]]
        if len(rule) > 10 and any(like(*sorted((rule, x), key=len)) for x in facts):
            continue
        hit = None
        if len(kw) >= 3:
            for k in reports + asked:
                other = keywords[k["description"]]
                both = len(kw & other)
                if other and (both / len(kw | other) > 0.5 or (both / len(kw | other) > 0.3 and both >= 3)):
                    hit = k
                    break
        if hit is not None:
            if v["is_report"] and not hit["is_report"]:
                asked.remove(hit)
                reports.append(v)
            continue
        if rule:
            facts.append(rule)
        (reports if v["is_report"] else asked).append(v)
    return reports, asked


def settled(reports, asked, keywords):
    """C10 as loops."""
    kept, shown = [], []
    for c in asked:
        kw = keywords[c["description"]]
        if len(kw) >= 2 and any(jac(kw, keywords[r["description"]]) > 0.3 for r in reports):
            continue
        if not any(jac(kw, keywords[k["description"]]) > 0.4 for k in kept):
            kept.append(c)
    for r in reports:
        kw = keywords[r["description"]]
        if not (len(kw) >= 2 and any(jac(kw, keywords[k["description"]]) > 0.35 for k in shown)):
            shown.append(r)
    return shown, kept


def test_the_whole_scan_equals_its_loops(spark):
    g = bindings.event_graph(spark, SF)
    told = spark.createDataFrame([(str(w), f"e{i}", f"{s} {v}", True, 5_000_000 + i, 1.0) for w in range(8) for i, (s, v) in enumerate((s, v) for s in SUBJECTS for v in VERBS)], "work_id string, id string, description string, is_linear boolean, seq long, story_order double")
    g = saved(Graph.of(spark, **{n: t for n, t in g.tables().items() if n != "events"} | {"events": g.events.limit(40).unionByName(told, allowMissingColumns=True)}))
    found = rules.scan(g).withColumn("id", F.concat(F.lit("violation-"), F.hex(F.xxhash64("work_id", "rule", "type", "description", "character_id", "seq"))))
    found = found.withColumns({"words": T.hangul_words("description"), "vid": F.xxhash64("rule", "description", "character_id", "seq")}).orderBy(F.desc("is_hard"), "rule_order", "seq", "vid").collect()
    r = random.Random(4)
    sure = {v.id: r.choice([0.2, 0.8, 0.95]) for v in found if r.random() < 0.4}
    corpus, events = findings.comparison_batches(g)
    sizes = {(b.work_id, b.batch): b.n for b in corpus.groupBy("work_id", "batch").agg(F.count("*").alias("n")).collect()}
    world = [(w, b, json.dumps([{"rule_index": r.randrange(n), "event_index": r.randrange(30), "description": f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {i % 3}분", "confidence": r.choice([0.5, 0.82, 0.95]), "severity": r.choice(["critical", "major", "minor"])} for i in range(12)])) for (w, b), n in sorted(sizes.items())]
    world = spark.createDataFrame(world, "work_id string, batch int, items string")
    new = findings.world_findings(world, corpus, events).orderBy("work_id", "batch", "seq").collect()
    texts = spark.createDataFrame([(x,) for x in {v.description for v in found} | {v.description for v in new}], "d string")
    keywords, words = ({x.d: set(x.k) for x in texts.select("d", f("d").alias("k")).collect()} for f in (T.report_keywords, T.hangul_words))
    want = set()
    for w in sorted({v.work_id for v in found} | {v.work_id for v in new}):
        own = [v for v in found if v.work_id == w]
        first = set(covered(own))
        known, seen = [], set()
        for v in own:
            if v.seq in first and (v.rule, v.seq, v.description) not in seen and any(v.vid == x.vid for x in _kept(own)):
                seen.add((v.rule, v.seq, v.description))
                fact = next((m[k] for k in ("fact", "rule") for m in v.evidence if m.get(k) is not None), None)
                known.append({"description": v.description, "is_report": v.is_hard or sure.get(v.id, 0.5) >= 0.8, "rule": None, "fact": fact})
        for k in known:
            k["fact"] = k["fact"] if k["is_report"] else k["description"]
        pairs, kept = set(), []
        for v in (v for v in new if v.work_id == w):
            if (v.rule[:50], v.event[:50]) in pairs:
                continue
            pairs.add((v.rule[:50], v.event[:50]))
            if not any(jac(words[v.description], words[k["description"]]) > 0.5 for k in kept):
                kept.append({"description": v.description, "is_report": v.is_hard, "rule": v.rule, "fact": None})
        reports, asked = settled(*merged(known, kept, keywords), keywords)
        want |= {(w, True, x["description"]) for x in reports} | {(w, False, x["description"]) for x in asked}
    chunks = spark.createDataFrame([("0", "k", "민수가 열쇠를 숨겼다는 말", 1)], "work_id string, chunk_id string, text string, seq long")
    verdicts = spark.createDataFrame(sorted(sure.items()), "violation_id string, confidence double")
    out = analysis.full_scan(g, chunks, verdicts, world)
    got = {(x.work_id, True, x.description) for x in out["reports"].collect()} | {(x.work_id, False, x.question) for x in out["confirmations"].collect()}
    assert got == want
    assert any("위반" in d or "모순" in d for _, _, d in got) and len(got) > 20
    total = {x.work_id: x.total for x in out["summary"].where("facet = 'all'").collect()}
    assert sum(total.values()) == out["reports"].count() + out["confirmations"].count()


def _kept(own):
    """The rows that the consolidation loop keeps, by row and not by seq, which rules share."""
    class Row:
        pass

    rows = []
    for i, v in enumerate(own):
        x = Row()
        x.words, x.type, x.evidence, x.character_id, x.seq = v.words, v.type, v.evidence, v.character_id, i
        rows.append(x)
    return [own[i] for i in covered(rows)]


def test_names_in_texts(spark):
    r = random.Random(3)
    names = [("w", "민수"), ("w", "영희"), ("w", "수영"), ("v", "민수"), ("v", "A B"), ("w", ""), ("v", "긴" * 300)]
    texts = [(r.choice("wv"), i, r.choice(["", " "]).join(r.choice(["민", "수", "영", "희", "A B", "x", "긴" * 301]) for _ in range(r.randint(0, 9)))) for i in range(150)] + [("w", 900, None)]
    got = names_in(spark.createDataFrame(texts, "work_id string, id long, text string"), spark.createDataFrame(names, "work_id string, name string"))
    assert {tuple(x) for x in got.collect()} == {(w, i, n) for w, i, t in texts for v, n in names if v == w and n and t and n in t}


def test_relationships_active_at_times(spark):
    r = random.Random(5)
    spans = [("w", r.choice(["hot", "hot", "b"]), i, r.choice([None, r.uniform(-5, 900)]), r.choice([None, r.uniform(0, 900), r.uniform(0, 900)])) for i in range(500)] + [("w", "b", 500, 3.0, 3.0), ("w", "b", 501, 1e9, None), ("w", "b", 502, -9.0, 2e9)]
    probes = [("w", r.choice(["hot", "b", "c"]), r.uniform(-20, 1000)) for _ in range(80)] + [("w", "b", 3.0), ("w", "b", 1e9), ("w", "b", None), ("w", "b", 3e9)]
    s = spark.createDataFrame(spans, "work_id string, from_id string, seq long, valid_from double, valid_until double")
    p = spark.createDataFrame(probes, "work_id string, from_id string, time double")
    want = sorted((s[2], t) for s in spans for w, f, t in probes if f == s[1] and t is not None and s[3] is not None and s[3] <= t and (s[4] is None or t <= s[4]))
    for width, levels in ((1.0, 24), (7.5, 6)):
        assert sorted((x.seq, x.time) for x in rules.active_at(s, p, width, levels).collect()) == want
    one = Graph.of(spark, related=s)
    assert sorted(x.seq for x in rules.relationships_at(one, 3.0).collect()) == sorted(s[2] for s in spans if s[3] is not None and s[3] <= 3.0 and (s[4] is None or s[4] >= 3.0))


def test_gaps_shorter_than_a_rule(spark):
    """Rules of few and of more keywords, in hours and minutes, against a search over all pairs."""
    r = random.Random(8)
    facts = [(w, f"f{i}", f"{r.choice(['최소', '적어도'])} {r.choice([2, 7, 30, 95])}{r.choice(['분', '시간'])} 소요 {' '.join(r.sample(['부산역', '대구항', '서울성', '광주탑', '강릉길'], r.choice([0, 1, 3])))}", i) for i in range(40) for w in "wv"]
    events = [(w, f"e{i}", f"{r.choice(['부산역', '대구항', '서울성', '제주섬'])}에 {r.choice(['오전 ', '오후 ', ''])}{r.randint(1, 12)}시 {r.randint(0, 59)}분 도착", r.choice([None, float(r.randrange(50))]), 0.1 * i, i) for i in range(120) for w in "wv"] + [("w", "x", "시각 없음", 1.0, 1.0, 999)]
    g = Graph.of(spark, facts=spark.createDataFrame(facts, "work_id string, id string, content string, seq long"), events=spark.createDataFrame(events, "work_id string, id string, description string, story_order double, discourse_order double, seq long"))
    minutes = {(x.work_id, x.seq): x.t for x in g.events.select("work_id", "seq", T.timestamp_minutes("description").alias("t")).collect()}
    limits = rules.constraints(g).where("kind = 'min_duration'").collect()
    want = set()
    for w in "wv":
        row = sorted(((so or do or 0.0, seq, d, minutes[w, seq]) for x, _, d, so, do, seq in events if x == w and minutes[w, seq] is not None))
        gaps = [(b[0], b[1], b[3] - a[3], f"{a[2]} {b[2]}", b[2]) for a, b in zip(row, row[1:]) if b[3] > a[3]]
        for c in (c for c in limits if c.work_id == w):
            least = c.least * 60 if c.unit == "시간" else c.least
            hit = next((x for x in gaps if x[2] < least and (len(c.kws) <= 2 or any(k in x[3] for k in c.kws))), None)
            if hit:
                want.add((w, c.fact_id, hit[1], hit[2]))
    got = {(x.work_id, x.evidence[0]["fact_id"], x.seq, int(x.evidence[0]["time_diff_min"])) for x in rules.broken_gaps(g).collect()}
    assert got == want and len(want) > 20


def test_a_fact_forbids_what_its_character_does(spark):
    chars = spark.createDataFrame([("w", "a", "민수", 1), ("w", "b", "영희", 2), ("v", "c", "민수", 1)], "work_id string, id string, name string, seq long")
    facts = spark.createDataFrame([("w", "f1", "영희와 민수는 커피를 절대 마시지 않는다", 1), ("w", "f2", "아무도 모르는 규칙은 금지된다", 2), ("v", "f3", "민수는 술을 마신다", 1)], "work_id string, id string, content string, seq long")
    events = spark.createDataFrame([("w", "e1", "민수가 커피를 마셨다", ["민수"], 1.0, 1), ("w", "e2", "영희가 커피를 마셨다", ["영희"], 2.0, 2), ("v", "e3", "민수가 커피를 마셨다", ["민수"], 1.0, 3)], "work_id string, id string, description string, characters_involved array<string>, story_order double, seq long")
    got = rules.broken_prohibitions(Graph.of(spark, characters=chars, facts=facts, events=events)).collect()
    assert [(x.work_id, x.character_name, x.evidence[0]["matched_keyword"], x.seq) for x in got] == [("w", "민수", "커피", 1)]
