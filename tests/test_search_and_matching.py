"""Search, matching with gold and merging of findings against plain loops, with a hot case and words that every text holds."""

import random

from pyspark.sql import functions as F
from test_consolidation import jac
from test_full_scan import merged

from storyloom.functions import text as T
from storyloom.operators import evaluate, findings, graph_ops, holding

WORDS = ["the", "of", "an", *(f"w{i}" for i in range(40)), "theory", "rare"]


def said(r, n):
    return " ".join(["the of an"] * (r.random() < 0.95) + [WORDS[min(len(WORDS) - 1, int(r.expovariate(0.09)))] for _ in range(n)])


def test_search_equals_the_loop(spark):
    r = random.Random(1)
    chunks = [(f"c{i}", (i * 7) % 300, said(r, r.randint(0, 12)).upper() if i % 5 == 0 else said(r, r.randint(0, 12))) for i in range(300)] + [("none", 900, None)]
    queries = [(q, said(r, r.randint(1, 9)) + r.choice(["", " The", " w7 w7"])) for q in range(25)] + [(90, ""), (91, "nowhere"), (92, None), (93, "the"), (94, "RARE theory the of an")]
    c, q = spark.createDataFrame(chunks, "id string, seq long, content string"), spark.createDataFrame(queries, "query_id long, query string")
    for top in (1, 5):
        want = set()
        for i, text in queries:
            words = (text or "").lower().split()
            scores = sorted((-sum(w in (x or "").lower() for w in words), s, k) for k, s, x in chunks)
            want |= {(i, n + 1, k, -s) for n, (s, _, k) in enumerate(x for x in scores[:top] if x[0] < 0)}
        got, work = graph_ops.searched(c, q, top, 2)
        assert {tuple(x) for x in got.select("query_id", "rank", "id", "score").collect()} == want
        assert {x.query_id for x in work.collect()} == {i for i, _ in queries if i not in (90, 91, 92)}
    assert min(x.scored for x in work.collect()) < 250  # a query with rare words does not meet every chunk
    assert graph_ops.search(c, q.limit(0)).count() == 0 and graph_ops.search(c.limit(0), q).count() == 0


def test_matching_equals_the_loop(spark):
    r = random.Random(2)
    violations = [(c, f"{c}{i}", r.randrange(40), said(r, r.randint(0, 8)), r.random() < 0.5) for c, n in (("hot", 250), ("b", 30), ("c", 4)) for i in range(n)]
    gold = [(c, f"g{c}{i}", r.randrange(20), r.choice([[], [None, "rare"], ["zz", "the"]]) if i % 9 == 0 else r.sample(WORDS, r.randint(1, 6)), "k", r.choice(["hard", "soft"])) for c, n in (("hot", 120), ("b", 30), ("d", 2)) for i in range(n)]
    v, g = spark.createDataFrame(violations, "case string, vid string, seq long, text string, is_hard boolean"), spark.createDataFrame(gold, "case string, gid string, seq long, keywords array<string>, category string, hard_soft string")
    score = lambda words, x: sum(bool(w) and w in x for w in words) / len(words) if words else 0.0
    for least in (0.3, 0.8):
        want, used = {}, set()
        for c, i, s, words, *_ in sorted(gold, key=lambda x: (x[0], x[2], x[1])):
            near = sorted((-score(words, x), q, vid) for k, vid, q, x, _ in violations if k == c and vid not in used and score(words, x) >= least)
            want[c, i] = near[0][2] if near else None
            used |= {near[0][2]} if near else set()
        assert {(x.case, x.gid): x.vid for x in evaluate.assign(v, g, least).collect()} == want
    pairs = {(x.case, x.gid, x.vid): x.score for x in evaluate.match_scores(v, g).collect()}
    assert pairs == {(c, i, vid): score(words, x) for c, i, _, words, *_ in gold for k, vid, _, x, _ in violations if k == c and score(words, x) > 0}
    assert evaluate.assign(v.limit(0), g, 0.3).where("vid IS NOT NULL").count() == 0 and evaluate.assign(v, g.limit(0)).count() == 0


def test_findings_are_merged_as_the_loop_does(spark):
    r = random.Random(3)
    words = ["민수", "영희", "학교", "비밀", "열쇠", "편지", "기차", "거짓", "진실", "어제"]
    rule = lambda: r.choice(["짧은 사실", "", "아주 오래된 학교의 비밀 규칙은 아무도 모른다고 했다", "그 아주 오래된 학교의 비밀 규칙은 아무도 모른다", "열쇠를 잃으면 누구도 문을 열 수 없다", "열쇠를 잃으면", f"전혀 다른 {r.randrange(50)}번째 규칙에 대한 설명", "사실"])
    told = lambda: " ".join(r.sample(words, r.randint(0, 6)))
    for seed in range(3):
        known = [{"w": w, "id": f"{w}k{i}", "seq": i, "is_report": i < 12, "description": told(), "fact": rule() if i % 3 else None, "rule": None} for w in ("hot", "b") for i in range(30 if w == "hot" else 5)]
        new = [{"w": w, "id": f"{w}n{i}", "seq": i, "is_report": r.random() < 0.5, "description": told(), "rule": rule() if i % 4 else None, "fact": None} for w in ("hot", "b", "c") for i in range(70 if w == "hot" else 8)]
        e = spark.createDataFrame([(k["w"], k["id"], k["seq"], k["is_report"], k["description"], k["fact"]) for k in known], "work_id string, id string, seq long, is_report boolean, description string, fact string")
        f = spark.createDataFrame([(k["w"], k["id"], k["seq"], k["is_report"], k["description"], k["rule"]) for k in new], "work_id string, id string, seq long, is_hard boolean, description string, rule string")
        keywords = {x.description: set(x.k) for x in e.select("description").union(f.select("description")).distinct().select("description", T.report_keywords("description").alias("k")).collect()}
        want = set()
        for w in ("hot", "b", "c"):
            reports, asked = merged([k for k in known if k["w"] == w], [k for k in new if k["w"] == w], keywords)
            want |= {k["id"] for k in reports + asked}
        assert {x.id for x in findings.cross_dedup(e, f).collect()} == want and any(jac(keywords[k["description"]], keywords[m["description"]]) > 0.5 for k in new for m in known)
    assert findings.cross_dedup(e.limit(0), f.limit(0)).count() == 0


def test_fact_recall_equals_the_loop(spark):
    r = random.Random(6)
    facts = [(c, said(r, r.randint(0, 6))) for c in ("x", "x", "x", "y", "z") for _ in range(6)]
    gold = [(c, " ".join(r.choice(["a", *WORDS]) for _ in range(r.randint(0, 7)))) for c in ("x", "y", "q") for _ in range(12)] + [("x", "theory rare"), ("x", "theory rare")]
    people = spark.createDataFrame([("x", "민수", ["수"])], "case string, name string, aliases array<string>")
    got = evaluate.extraction_metrics(people, spark.createDataFrame(facts, "case string, content string"), people.select("case", "name"), spark.createDataFrame(gold, "case string, content string"))
    want = {}
    for c in ("x", "y", "q"):
        hits = 0
        own = [t for k, t in gold if k == c]
        for t in own:
            words = [w for w in t.split() if len(w) >= 2][:5]
            hits += any(sum(w in f for w in words) >= max(1, len(words) // 2) for k, f in facts if k == c)
        want[c] = hits / len(own)
    assert {x.case: x.fact_recall for x in got.collect() if x.fact_recall is not None} == want and 0 < want["x"]


def test_search_and_matching_move_texts_once(spark, monkeypatch):
    """No row for each word that a text holds: common words in every text left hundreds of rows a text before."""
    made = []
    keep = lambda df: made.append(out := plain(df)) or out
    plain = graph_ops.stored
    for m in (graph_ops, evaluate, holding):
        monkeypatch.setattr(m, "stored", keep)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    c = spark.createDataFrame([(f"c{i}", i, " ".join(words)) for i in range(50)], "id string, seq long, content string")
    q = spark.createDataFrame([(i, " ".join(words[i:])) for i in range(3)], "query_id long, query string")
    assert [(x.query_id, x.rank, x.id, x.score) for x in graph_ops.search(c, q, 2).orderBy("query_id", "rank").collect()] == [(i, k + 1, f"c{k}", 100 - i) for i in range(3) for k in range(2)]
    v = c.select(F.lit("x").alias("case"), F.col("id").alias("vid"), "seq", F.col("content").alias("text"), F.lit(True).alias("is_hard"))
    g = q.select(F.lit("x").alias("case"), F.col("query_id").cast("string").alias("gid"), F.col("query_id").alias("seq"), F.split("query", " ").alias("keywords"), F.lit("k").alias("category"), F.lit("hard").alias("hard_soft"))
    assert evaluate.match_scores(v, g, 0.8).where("score = 1").count() == 150
    assert max(t.count() for t in made) <= 50
