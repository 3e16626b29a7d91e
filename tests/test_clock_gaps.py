"""D18 over works in slices and ranges against a plain search, and how much it writes."""

import random

from storyloom.functions import text as T
from storyloom.operators import rules
from storyloom.plans import bindings
from storyloom.plans.graph import Graph
from storyloom.plans.stored import shuffles_freed

PLACES = ["부산역", "대구항", "서울성", "제주섬"]


def test_gaps_across_slices_and_ranges(spark, tmp_path, monkeypatch):
    """Works dealt into many slices, events over ranges that end within a work, ties in the order, texts without a time."""
    r = random.Random(18)
    works = [f"w{i}" for i in range(9)] + [None]
    facts = [(w, f"f{i}", f"최소 {r.choice([1, 7, 30, 95])}{r.choice(['분', '분', '시간'])} 소요 {' '.join(r.sample(PLACES, r.choice([0, 3])))}", i) for i in range(6) for w in works]
    events = [(w, f"e{i}", f"{r.choice(PLACES)}에 {r.choice(['오전 ', '오후 ', ''])}{r.randint(1, 12)}시 {r.randint(0, 59)}분 도착", float(r.randrange(40)), r.randrange(5)) for i in range(90) for w in works]
    events += [(w, "x", text, 7.0, 3) for w in works for text in ("시각 없음", "12분 뒤", None)]
    spark.createDataFrame(events, "work_id string, id string, description string, story_order double, seq long").repartition(3).write.parquet(f"{tmp_path}/events")
    g = Graph.of(spark, facts=spark.createDataFrame(facts, "work_id string, id string, content string, seq long"), events=spark.read.parquet(f"{tmp_path}/events"))
    minutes = {x.d: x.t for x in g.events.select(g.events.description.alias("d"), T.timestamp_minutes("description").alias("t")).distinct().collect()}
    want = set()
    for c in rules.constraints(g).where("kind = 'min_duration' AND work_id IS NOT NULL").collect():
        row = sorted((at, seq, d) for w, _, d, at, seq in events if w == c.work_id and minutes[d] is not None)
        gaps = [(b, minutes[b[2]] - minutes[a[2]], f"{a[2]} {b[2]}") for a, b in zip(row, row[1:])]
        hit = next((x for x in gaps if 0 < x[1] < c.least * (60 if c.unit == "시간" else 1) and (len(c.kws) <= 2 or any(k in x[2] for k in c.kws))), None)
        if hit:
            want.add((c.work_id, c.fact_id, *hit[0], hit[1]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size in (1 << 30, 4000):
            monkeypatch.setattr(rules, "SLICE", size)
            got = {(x.work_id, x.evidence[0]["fact_id"], float(x.description.split("story_order=")[1].split(")")[0]), x.seq, x.dialogue, int(x.evidence[0]["time_diff_min"])) for x in rules.broken_gaps(g).collect()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) > 20


def _shuffled(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_gaps_no_rule_is_long_enough_for_are_not_written(spark):
    """Over the line items: less than 100 bytes an event are shuffled (more than twice that when every gap met its words)."""
    g = bindings.clock_graph(spark, "/root/testdata/sf0.01")
    before = _shuffled(spark)
    assert rules.broken_gaps(g).count() > 1000
    assert _shuffled(spark) - before < 100 * 60_000


def test_shuffle_files_are_freed_only_within(spark):
    name, was = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == was
