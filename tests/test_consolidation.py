"""De-duplication and packing without one group a work, and kept graphs, against plain loops."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import consolidate
from storyloom.plans.graph import Graph
from storyloom.plans.numbering import running_sum
from storyloom.sources import graphs

WORDS = ["민수", "영희", "철수", "학교", "비밀", "사망", "열쇠", "편지", "기차", "거짓", "진실", "어제"]


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def violations(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = r.sample(WORDS[: r.choice([4, 12])], r.randint(0, 4))
        evidence = r.choice([[], [{"fact_id": f"f{r.randrange(25)}"}], [{"note": "x"}, {"fact": f"g{r.randrange(9)}"}], [{"fact_id": ""}]])
        rows.append((r.choice(["hot", "hot", "b"]), r.randrange(4), i, f"rule{r.randrange(3)}", r.choice("tu"), r.choice([None, "", "c1", "c2"]), r.random() < 0.4, " ".join(words), evidence))
    return spark.createDataFrame(rows, "work_id string, rule_order int, seq long, rule string, type string, character_id string, is_hard boolean, description string, evidence array<map<string,string>>")


def covered(rows):
    """The rule as one loop over a work's violations."""
    facts, exact, by, kept_words, keep = set(), set(), {}, [], []
    for r in rows:
        words = set(r.words)
        fact = next((m["fact_id"] for m in r.evidence if "fact_id" in m), None)
        fact = fact if fact is not None else next((m["fact"] for m in r.evidence if "fact" in m), None)
        if fact:
            if fact in facts:
                continue
            facts.add(fact)
        key = (r.type, tuple(sorted(words)))
        if key in exact:
            continue
        if r.character_id:
            before = by.setdefault((r.type, r.character_id), [])
            if any(jac(words, b) > 0.5 for b in before):
                continue
            before.append(words)
        if len(words) >= 3 and any(jac(words, b) > 0.45 for b in kept_words):
            continue
        exact.add(key)
        if len(words) >= 3:
            kept_words.append(words)
        keep.append(r.seq)
    return keep


def test_consolidation_equals_the_loop(spark):
    for seed, n in ((1, 60), (2, 400)):
        v = violations(spark, n, seed)
        rows = v.withColumns({"words": T.hangul_words("description"), "vid": F.xxhash64("rule", "description", "character_id", "seq")}).orderBy(F.desc("is_hard"), "rule_order", "seq", "vid").collect()
        want = {(w, s) for w in ("hot", "b") for s in covered([r for r in rows if r.work_id == w])}
        assert {(r.work_id, r.seq) for r in consolidate.consolidate(v).collect()} == want and len(want) > 10
    assert consolidate.consolidate(v.limit(0)).count() == 0


def test_a_class_of_many_characters_has_few_edges(spark, monkeypatch):
    """Rows of one type and the same words of two hundred characters, and their second rows, most of which the first exclude."""
    rows = [("w", 0, i, "rule", "t", "new" if i == 201 else f"c{i % 200}", False, ("민수 학교 비밀" if i < 200 else "민수 학교 비밀 열쇠") if i % 5 else "기차 거짓", []) for i in range(400)]
    v = spark.createDataFrame(rows, "work_id string, rule_order int, seq long, rule string, type string, character_id string, is_hard boolean, description string, evidence array<map<string,string>>")
    seen, fit = [], consolidate.first_fit
    monkeypatch.setattr(consolidate, "first_fit", lambda edges: (seen.append(edges.count()), fit(edges))[1])
    got = sorted(r.seq for r in consolidate.consolidate(v).collect())
    ordered = v.withColumns({"words": T.hangul_words("description"), "vid": F.xxhash64("rule", "description", "character_id", "seq")}).orderBy("seq").collect()
    assert got == covered(ordered) and max(seen) < 10 * len(rows)


def test_batches_equal_the_loop(spark):
    r = random.Random(5)
    corpus = [(w, i, "x" * r.choice([1, 3, 40, 90, 300])) for w, n in (("hot", 700), ("b", 30), ("c", 1), ("full", 9)) for i in range(n)]
    events = [("hot", "e" * 20), ("hot", "e" * 9), ("full", "e" * 600)]
    size = {w: len("\n".join(t for x, t in events if x == w)) for w, *_ in corpus}
    want, batch, total = {}, {}, {}
    for w, i, t in corpus:
        b = batch.setdefault(w, 0)
        want[w, i] = b
        total[w] = total.get(w, size[w]) + len(t)
        if total[w] > 500:
            batch[w], total[w] = b + 1, size[w]
    df = spark.createDataFrame(corpus, "work_id string, seq long, text string").repartition(5)
    ev = spark.createDataFrame(events, "work_id string, text string")
    assert {(x.work_id, x.seq): x.batch for x in consolidate.batches(df, ev, 500).collect()} == want
    assert consolidate.batches(df.limit(0), ev, 500).count() == 0


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "b", None]), i, r.randrange(9)) for i in range(800)]
    got = {x.i: x.total for x in running_sum(spark.createDataFrame(rows, "w string, i long, n long").repartition(6), "n", ["i"], ["w"]).collect()}
    at, want = {}, {}
    for w, i, n in rows:
        want[i] = at.get(w, 0)
        at[w] = want[i] + n
    assert got == want


def test_text_dedup_equals_the_loop(spark):
    r = random.Random(9)
    rows = [(w, f"{w}{i}", i, r.random() < 0.5, " ".join(r.sample(WORDS, r.randint(0, 5)))) for w, n in (("hot", 150), ("b", 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "work_id string, id string, seq long, is_report boolean, text string")
    words = {x.id: set(x.k) for x in df.select("id", T.report_keywords("text").alias("k")).collect()}

    def loop(ids, least, few=0):
        kept = []
        for i in ids:
            if len(words[i]) < few or not any(jac(words[i], words[k]) > least for k in kept):
                kept.append(i)
        return kept

    ids = lambda w, rep=None: [x[1] for x in rows if x[0] == w and (rep is None or x[3] == rep)]
    assert {x.id for x in consolidate.greedy_text_dedup(df, 0.5).collect()} == {i for w in ("hot", "b") for i in loop(ids(w), 0.5)}
    want = set()
    for w in ("hot", "b"):
        report = ids(w, True)
        asked = [i for i in ids(w, False) if len(words[i]) < 2 or not any(jac(words[i], words[k]) > 0.3 for k in report)]
        want |= set(loop(report, 0.35, 2)) | set(loop(asked, 0.4))
    assert {x.id for x in consolidate.final_dedup(df).collect()} == want


def test_kept_graphs_rewrite_only_touched_works(spark, tmp_path):
    path = str(tmp_path / "graph")
    events = lambda *r: spark.createDataFrame([(*x, True, 1.0, 1) for x in r], "work_id string, id string, is_linear boolean, story_order double, seq long")
    facts = spark.createDataFrame([("w", "f1", "하나", 1), ("v", "f2", "둘", 2), ("u", "f3", "셋", 3)], "work_id string, id string, content string, seq long")
    g = Graph.of(spark, events=events(("w", "e1"), ("v", "e2"), ("u", "e3")), facts=facts)
    graphs.write_graph(g, path)
    files = lambda w: sorted((p.name, p.stat().st_mtime_ns) for p in Path(path).rglob(f"work_id={w}/*.parquet"))
    before = files("v")
    new = Graph.of(spark, events=events(("w", "e1"), ("w", "e9")))  # the work has lost its fact
    graphs.replace_works(new, path, spark.createDataFrame([("w",)], "work_id string"))
    back = graphs.read_graph(spark, path)
    assert sorted((r.work_id, r.id) for r in back.events.collect()) == [("u", "e3"), ("v", "e2"), ("w", "e1"), ("w", "e9")]
    assert sorted(r.id for r in back.facts.collect()) == ["f2", "f3"] and files("v") == before
    again = graphs.confirmed_nonlinear(spark, path, spark.createDataFrame([("u", "e3", "story_order:4.5")], "work_id string, id string, response string"))
    assert [(r.id, r.is_linear, r.story_order) for r in again.events.collect()] == [("e3", False, 4.5)] and files("v") == before
    assert {r.id: r.story_order for r in graphs.read_graph(spark, path).events.collect()} == {"e1": 1.0, "e2": 1.0, "e3": 4.5, "e9": 1.0}
