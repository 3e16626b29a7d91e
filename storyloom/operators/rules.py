"""The catalogue of contradiction rules: each takes a Graph and gives violation rows.

Every rule is per work_id. Edges marked as intended are left out but where a rule says otherwise. ``seq`` orders the
violations of one rule. Minima and last values are aggregated before joins, so a protagonist's many edges are
combined on the map side, and what is left of a hot key is split by adaptive joins.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from storyloom.functions import lexicons as L
from storyloom.functions import text as T
from storyloom.operators.holding import holding, names_in
from storyloom.plans.graph import Graph, unmarked
from storyloom.plans.numbering import numbered
from storyloom.plans.stored import dropped, input_bytes, shuffles_freed, stored, stored_each

COLUMNS = ["work_id", "rule", "type", "severity", "description", "confidence", "character_id", "character_name", "evidence", "needs_user_input", "confirmation_type", "dialogue", "chunk_id", "is_hard", "seq"]
#: Bytes of input whose works are taken at once where a rule writes all events.
SLICE = 512 << 20


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def say(*parts) -> Column:
    """A description of literal texts and columns; a null column reads None. Columns come as Column."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def violations(df: DataFrame, rule: str, kind: str, severity, description: Column, confidence, evidence: dict, ask=False, confirmation=None, character="character_id", name="character_name", dialogue=None, chunk="chunk_id") -> DataFrame:
    """df as violation rows; df has work_id and seq."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    own = lambda c: F.col(c).cast("string") if isinstance(c, str) and c in df.columns else F.lit(None).cast("string") if not isinstance(c, Column) else c
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), _text(v))]
    out = df.select(
        "work_id", F.lit(rule).alias("rule"), F.lit(kind).alias("type"), col(severity).alias("severity"), description.alias("description"), col(confidence).cast("double").alias("confidence"),
        own(character).alias("character_id"), own(name).alias("character_name"), F.array(F.create_map(*pairs)).alias("evidence"), col(ask).alias("needs_user_input"),
        F.when(col(ask), F.lit(confirmation)).cast("string").alias("confirmation_type"), own(dialogue).alias("dialogue"), own(chunk).alias("chunk_id"), F.col("seq").cast("long").alias("seq"),
    )
    return out.withColumn("is_hard", (F.col("confidence") >= 0.8) & ~F.col("needs_user_input")).select(COLUMNS)


def _named(df: DataFrame, g: Graph, id_col: str, as_: str = "character_name") -> DataFrame:
    """df with the name of a character, or its id where there is none."""
    names = g.characters.groupBy("work_id", F.col("id").alias(id_col)).agg(F.max_by("name", "seq").alias(as_))
    return df.join(names, ["work_id", id_col], "left").withColumn(as_, F.coalesce(as_, id_col))


def name_ids(g: Graph) -> DataFrame:
    """(work_id, name, id): of equal names the last vertex."""
    return g.characters.where("name <> '' AND id IS NOT NULL").groupBy("work_id", "name").agg(F.max_by("id", "seq").alias("id"))


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key, one aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def mention_before_learning(g: Graph) -> DataFrame:
    """A character mentions a fact before first learning it; one who never learns it is not reported."""
    key = ["work_id", "from_id", "to_id"]
    learned = unmarked(g.learns).where("story_order IS NOT NULL").groupBy(*key).agg(F.min("story_order").alias("learned"))
    bad = unmarked(g.mentions).join(learned, key).where("story_order < learned").withColumn("character_id", F.col("from_id"))
    say_ = say("캐릭터 '", F.col("character_name"), "'이(가) 사실을 알기 전(LEARNS story_order=", F.col("learned"), ") 이미 언급(MENTIONS story_order=", F.col("story_order"), ")")
    return violations(_named(bad, g, "from_id"), "D1", "information_asymmetry", "critical", say_, 0.95, {"mentioned_at": "story_order", "learned_at": "learned"}, dialogue="dialogue_text")


def taught_by_ignorant(g: Graph) -> DataFrame:
    """A character learns from one who first knows or mentions the fact later; once for each student, teacher and fact."""
    learns, mentions = (unmarked(x).where("story_order IS NOT NULL") for x in (g.learns, g.mentions))
    known = learns.select("work_id", "from_id", "to_id", "story_order").union(mentions.select("work_id", "from_id", "to_id", "story_order"))
    known = known.groupBy("work_id", F.col("from_id").alias("teacher_id"), "to_id").agg(F.min("story_order").alias("teacher_at"))
    teachers = name_ids(g).select("work_id", F.col("name").alias("via_character"), F.col("id").alias("teacher_id"))
    bad = learns.join(teachers, ["work_id", "via_character"]).where("teacher_id <> from_id").join(known, ["work_id", "teacher_id", "to_id"]).where("teacher_at > story_order")
    bad = _first(bad.select("work_id", "from_id", "teacher_id", "to_id", "story_order", "teacher_at", "dialogue_text", "chunk_id", "seq"), ["work_id", "from_id", "teacher_id", "to_id"], "seq")
    bad = _named(_named(bad, g, "from_id"), g, "teacher_id", "teacher_name").withColumn("character_id", F.col("from_id"))
    who, by = F.col("character_name"), F.col("teacher_name")
    say_ = say("'", who, "'이(가) '", by, "'에게서 사실을 배우지만(story_order=", F.col("story_order"), "), '", by, "'의 해당 사실 최초 인지는 더 늦음(story_order=", F.col("teacher_at"), ")")
    return violations(bad, "D2", "information_asymmetry", "critical", say_, 0.85, {"student": "character_name", "teacher": "teacher_name", "fact_id": "to_id", "learned_at": "story_order", "teacher_at": "teacher_at"}, dialogue="dialogue_text")


def deaths(g: Graph) -> DataFrame:
    """(work_id, from_id, died): the death written last counts."""
    return unmarked(g.statuses).where("status_type = 'dead' AND story_order IS NOT NULL").groupBy("work_id", "from_id").agg(F.max_by("story_order", "seq").alias("died"))


def _after_death(g: Graph) -> DataFrame:
    """One appearance after death for each character: places first, then mentions, then what is learned."""
    seen = [unmarked(x).select("work_id", "from_id", "story_order", "dialogue_text", "chunk_id", F.lit(r).alias("rank"), F.lit(n).alias("edge"), "seq") for r, n, x in ((0, "AT_LOCATION", g.locations), (1, "MENTIONS", g.mentions), (2, "LEARNS", g.learns))]
    late = seen[0].union(seen[1]).union(seen[2]).join(deaths(g), ["work_id", "from_id"]).where("story_order > died")
    return _first(late, ["work_id", "from_id", "died"], "rank", "seq")


def appears_after_death(g: Graph) -> DataFrame:
    """D3: a character is somewhere, speaks or learns after death; once for each character."""
    bad = _named(_after_death(g), g, "from_id").withColumn("character_id", F.col("from_id"))
    say_ = say("캐릭터 '", F.col("character_name"), "'이(가) 사망(story_order=", F.col("died"), ") 후 재등장(story_order=", F.col("story_order"), ")")
    return violations(bad, "D3", "timeline", "critical", say_, 0.95, {"death_at": "died", "appears_at": "story_order", "edge": "edge"}, dialogue="dialogue_text")


def _acts_after_death(g: Graph) -> DataFrame:
    cast = g.events.where("story_order IS NOT NULL").select("work_id", "story_order", "description", "chunk_id", "seq", F.posexplode("characters_involved").alias("pos", "name"))
    late = cast.join(name_ids(g).withColumnRenamed("id", "from_id"), ["work_id", "name"]).join(deaths(g), ["work_id", "from_id"]).where("story_order > died")
    first = _first(late, ["work_id", "from_id", "died"], "seq", "pos")
    return first.join(_after_death(g).select("work_id", "from_id"), ["work_id", "from_id"], "left_anti")


def acts_after_death(g: Graph) -> DataFrame:
    """A character takes part in an event after death, where D3 has not reported it."""
    bad = _acts_after_death(g).withColumns({"character_id": F.col("from_id"), "character_name": F.col("name")})
    say_ = say("캐릭터 '", F.col("name"), "'이(가) 사망(story_order=", F.col("died"), ") 후 이벤트에 등장(story_order=", F.col("story_order"), "): ", F.substring("description", 1, 60))
    return violations(bad, "D4", "timeline", "critical", say_, 0.95, {"death_at": "died", "appears_at": "story_order", "event": "description"}, dialogue="description")


def two_places(g: Graph) -> DataFrame:
    """A character is in more than one place at one time. The text counts edges, the test places."""
    at = unmarked(g.locations).where("story_order IS NOT NULL AND to_id IS NOT NULL")
    bad = at.groupBy("work_id", "from_id", "story_order").agg(F.count("*").alias("n"), F.countDistinct("to_id").alias("places"), F.min("seq").alias("seq"), F.array_sort(F.collect_set("to_id")).alias("where")).where("places > 1")
    bad = _named(bad, g, "from_id").withColumn("character_id", F.col("from_id"))
    say_ = say("캐릭터 '", F.col("character_name"), "'이(가) story_order=", F.col("story_order"), "에 동시에 ", F.col("n"), "개 장소 존재")
    return violations(bad, "D5", "timeline", "critical", say_, 0.98, {"locations": F.concat_ws(",", "where"), "story_order": "story_order"})


def resurrections(g: Graph) -> DataFrame:
    """An event of resurrection, once for each participant whose death was not reported before; without one, once."""
    e = g.events.where("event_type = 'resurrection'").withColumn("at", F.coalesce(F.nullif("story_order", F.lit(0.0)), F.nullif("discourse_order", F.lit(0.0)), F.lit(0.0)))
    cast = e.select("work_id", "id", "at", "description", "chunk_id", "seq", F.posexplode_outer(F.array_distinct("characters_involved")).alias("pos", "name"))
    first_id = g.characters.groupBy("work_id", "name").agg(F.min_by("id", "seq").alias("from_id"))
    who = cast.where("name IS NOT NULL").join(first_id, ["work_id", "name"], "left").withColumn("from_id", F.coalesce("from_id", "name")).join(deaths(g), ["work_id", "from_id"], "left")
    told = _after_death(g).select("work_id", "from_id").union(_acts_after_death(g).select("work_id", "from_id"))
    fresh = who.where("died IS NOT NULL").join(told, ["work_id", "from_id"], "left_anti")
    dead = _first(fresh.select("work_id", "from_id", "id", "at", "description", "chunk_id", "seq", "pos", "name"), ["work_id", "from_id"], "seq", "pos")
    alive = who.where("died IS NULL").select(dead.columns)
    bad = dead.union(alive).withColumns({"character_id": F.col("from_id"), "character_name": F.col("name")})
    say_ = say("캐릭터 '", F.col("name"), "'이(가) 사망 후 재등장(story_order=", F.col("at"), "): ", F.substring("description", 1, 80))
    named = violations(bad, "D6", "timeline", "critical", say_, 0.92, {"event": "id", "story_order": "at"}, dialogue="description")
    say_ = say("사망 후 재등장 이벤트 감지(story_order=", F.col("at"), "): ", F.substring("description", 1, 80))
    return named.unionByName(violations(cast.where("name IS NULL"), "D6", "timeline", "critical", say_, 0.85, {"event": "id", "story_order": "at"}, dialogue="description"))


def relationship_conflicts(g: Graph) -> DataFrame:
    """Two relationships of an unordered pair of characters that exclude each other. Repeats count, validity does not."""
    r = unmarked(g.related).where("from_id IS NOT NULL AND to_id IS NOT NULL AND relationship_type IS NOT NULL")
    r = r.select("work_id", F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi"), F.col("relationship_type").alias("kind"), "seq")
    level = F.create_map(*(F.lit(x) for a, b, v in L.CONFLICTS for p in ((a, b), (b, a)) for x in ("|".join(p), v)))
    other = r.select("work_id", "lo", "hi", F.col("kind").alias("kind2"), F.col("seq").alias("seq2"))
    # only types with an opponent are paired
    in_matrix = F.col("kind").isin(sorted({x for a, b, _ in L.CONFLICTS for x in (a, b)}))
    pairs = r.where(in_matrix).join(other.where(F.col("kind2").isin(sorted({x for a, b, _ in L.CONFLICTS for x in (a, b)}))), ["work_id", "lo", "hi"]).where("seq < seq2")
    bad = pairs.withColumn("level", F.element_at(level, F.concat_ws("|", "kind", "kind2"))).where("level IS NOT NULL")
    sure = F.col("level") == "critical"
    say_ = say("캐릭터 쌍의 관계 ", F.when(sure, "모순").otherwise("경고"), ": ", F.col("kind"), " ↔ ", F.col("kind2"))
    return violations(bad, "D7", "relationship", F.when(sure, "critical").otherwise("major"), say_, F.when(sure, 0.95).otherwise(0.6), {"pair": F.concat_ws(",", "lo", "hi"), "types": F.concat_ws(",", "kind", "kind2"), "seq2": "seq2"}, ~sure, "relationship_ambiguity")


def active_at(related: DataFrame, probes: DataFrame, width: float = 1.0, levels: int = 24) -> DataFrame:
    """Probes (work_id, from_id, time) with the relationships of that character that are valid then: the columns of ``related``, and time.

    The order axis is cut into bins of ``width``. An interval goes to the few nodes of a binary tree over the bins that make it
    up, and a probe to the nodes above its bin, so both stay small however long an interval is, and a character with many
    of them is spread over nodes; the exact test follows. Open ends stay valid; orders beyond the tree's ends count to them.
    """
    top = (1 << levels) - 1
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) / width), F.lit(0)), F.lit(top)).cast("long")
    nodes = f"""aggregate(sequence(0, {levels}), named_struct('l', _l, 'r', _r + 1, 'out', cast(array() as array<struct<level:int,node:bigint>>)), (a, k) ->
      CASE WHEN a.l >= a.r THEN a ELSE named_struct('l', shiftright(a.l + a.l % 2, 1), 'r', shiftright(a.r - a.r % 2, 1), 'out', concat(a.out,
        CASE WHEN a.l % 2 = 1 THEN array(named_struct('level', k, 'node', a.l)) ELSE array() END,
        CASE WHEN a.r % 2 = 1 THEN array(named_struct('level', k, 'node', a.r - 1)) ELSE array() END)) END, a -> a.out)"""
    spans = related.where("valid_from IS NOT NULL AND (valid_until IS NULL OR valid_from <= valid_until)").withColumns({"_l": at("valid_from"), "_r": F.when(F.col("valid_until").isNull(), F.lit(top).cast("long")).otherwise(at("valid_until"))})
    spans = spans.withColumn("_n", F.explode(F.expr(nodes))).select(*related.columns, "_n.level", "_n.node")
    asked = probes.select("work_id", "from_id", "time").where("time IS NOT NULL").withColumn("_b", at("time"))
    asked = asked.select("work_id", "from_id", "time", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "_b").withColumn("node", F.expr("shiftright(_b, level)")).drop("_b")
    found = spans.join(asked, ["work_id", "from_id", "level", "node"])
    return found.where("valid_from <= time AND (valid_until IS NULL OR time <= valid_until)").select(*related.columns, "time")


def relationships_at(g: Graph, time: float) -> DataFrame:
    """The relationships that are valid at a time; an open end stays valid."""
    return g.related.where((F.col("valid_from") <= time) & (F.col("valid_until").isNull() | (F.lit(time) <= F.col("valid_until"))))


def trait_conflicts(g: Graph) -> DataFrame:
    """Different values of one trait key of a character; keys that take many values are left out."""
    t = g.traits.select("work_id", F.col("id").alias("to_id"), "key", "value", "is_immutable").dropDuplicates(["work_id", "to_id"])
    own = unmarked(g.has_trait).join(t, ["work_id", "to_id"]).where(F.col("key").isNotNull() & ~F.col("key").isin(L.MULTI_VALUE_TRAITS))
    v = F.coalesce("value", F.lit("None"))
    bad = own.groupBy("work_id", "from_id", "key").agg(F.countDistinct(v).alias("n"), F.max(F.coalesce("is_immutable", F.lit(False))).alias("fixed"), F.array_sort(F.collect_list(F.struct("seq", v.alias("v")))).alias("all"), F.min("seq").alias("seq")).where("n > 1")
    bad = _named(bad, g, "from_id").withColumns({"character_id": F.col("from_id"), "values": F.concat_ws(", ", "all.v")})
    fixed = F.col("fixed")
    say_ = say("캐릭터 '", F.col("character_name"), "'의 특성 '", F.col("key"), "': [", F.col("values"), "]")
    return violations(bad, "D8", "trait", F.when(fixed, "critical").otherwise("major"), say_, F.when(fixed, 0.95).otherwise(0.6), {"trait_key": "key", "values": "values"}, ~fixed, "intentional_change")


def emotion_flips(g: Graph) -> DataFrame:
    """Consecutive feelings of one character for another are opposites and the later has no trigger."""
    w = Window.partitionBy("work_id", "from_id", "to_id").orderBy(F.coalesce("discourse_order", F.lit(0.0)), "seq")
    f = unmarked(g.feels).where("from_id IS NOT NULL AND to_id IS NOT NULL").withColumn("before", F.lag("emotion").over(w))
    opposite = F.lit(False)
    for a, b in L.OPPOSITE_EMOTIONS:
        opposite = opposite | ((F.col("before") == a) & (F.col("emotion") == b)) | ((F.col("before") == b) & (F.col("emotion") == a))
    bad = _named(f.where(opposite & (F.coalesce("trigger_event_id", F.lit("")) == "")), g, "from_id").withColumn("character_id", F.col("from_id"))
    say_ = say("캐릭터 '", F.col("character_name"), "'의 감정이 트리거 없이 ", F.col("before"), " → ", F.col("emotion"), " 급변")
    return violations(bad, "D9", "emotion", "major", say_, 0.6, {"prev": "before", "curr": "emotion", "to": "to_id"}, True, "emotion_shift", dialogue="dialogue_text")


def _item_names(df: DataFrame, g: Graph) -> DataFrame:
    names = g.items.groupBy("work_id", F.col("id").alias("to_id")).agg(F.max_by("name", "seq").alias("item_name"), F.max_by("is_unique", "seq").alias("is_unique"))
    return df.join(names, ["work_id", "to_id"], "left").withColumn("item_name", F.coalesce("item_name", "to_id"))


def shared_items(g: Graph) -> DataFrame:
    """Several owners of an item at one time. The text counts edges, the test owners."""
    p = unmarked(g.possesses).where("story_order IS NOT NULL AND to_id IS NOT NULL")
    bad = p.groupBy("work_id", "to_id", "story_order").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("owners"), F.array_sort(F.collect_set("from_id")).alias("who"), F.min("seq").alias("seq")).where("owners > 1")
    say_ = say("아이템 '", F.col("item_name"), "'이 story_order=", F.col("story_order"), "에 ", F.col("n"), "명에게 동시 소유")
    return violations(_item_names(bad, g), "D10", "item", "critical", say_, 0.95, {"item_id": "to_id", "story_order": "story_order", "owners": F.concat_ws(",", "who")})


def repossessions(g: Graph) -> DataFrame:
    """An owner has an item again after losing it; each time is reported. At one time possession comes before loss."""
    both = [unmarked(x).where("story_order IS NOT NULL AND to_id IS NOT NULL").select("work_id", "from_id", "to_id", "story_order", "chunk_id", "seq", F.lit(r).alias("rank")) for r, x in ((0, g.possesses), (1, g.loses))]
    w = Window.partitionBy("work_id", "to_id", "from_id").orderBy("story_order", "rank", "seq").rowsBetween(Window.unboundedPreceding, -1)
    h = both[0].union(both[1]).withColumn("lost", F.last(F.when(F.col("rank") == 1, F.col("story_order")), True).over(w))
    bad = _item_names(_named(h.where("rank = 0 AND story_order > lost"), g, "from_id"), g).withColumn("character_id", F.col("from_id"))
    say_ = say("캐릭터 '", F.col("character_name"), "'이(가) '", F.col("item_name"), "' 분실(story_order=", F.col("lost"), ") 후 재소유(story_order=", F.col("story_order"), ")")
    return violations(bad, "D11", "item", "major", say_, 0.65, {"lost_at": "lost", "repossessed_at": "story_order", "item_id": "to_id"}, True, "item_discrepancy")


def unexplained_transfers(g: Graph) -> DataFrame:
    """A unique item goes to another owner although the one before never loses it."""
    p = unmarked(g.possesses).where("story_order IS NOT NULL AND to_id IS NOT NULL")
    w = Window.partitionBy("work_id", "to_id").orderBy("story_order", "seq")
    moved = _item_names(p, g).where("is_unique").withColumn("owner", F.lag("from_id").over(w)).where("owner <> from_id")
    losers = unmarked(g.loses).where("story_order IS NOT NULL").select("work_id", "to_id", F.col("from_id").alias("owner")).distinct()
    bad = _named(_named(moved.join(losers, ["work_id", "to_id", "owner"], "left_anti"), g, "from_id"), g, "owner", "owner_name")
    say_ = say("유일 아이템 '", F.col("item_name"), "': '", F.col("owner_name"), "'이(가) 분실 기록 없이 '", F.col("character_name"), "'이(가) 소유(story_order=", F.col("story_order"), ")")
    return violations(bad, "D12", "item", "critical", say_, 0.85, {"item_id": "to_id", "prev_owner": "owner_name", "curr_owner": "character_name"}, True, "item_discrepancy", character=None, name=None)


def _false_facts(g: Graph) -> DataFrame:
    return g.facts.where("NOT is_true").select("work_id", F.col("id").alias("to_id"), "content").dropDuplicates(["work_id", "to_id"])


def lies_after_truth(g: Graph) -> DataFrame:
    """A false fact is mentioned after its truth was learned, that is after learning it with believed_true false.

    This is the documented rule; looked up among facts that are not false it could never hold.
    """
    false = _false_facts(g).select("work_id", "to_id")
    key = ["work_id", "from_id", "to_id"]
    truth = unmarked(g.learns).where("NOT believed_true AND story_order IS NOT NULL").join(false, ["work_id", "to_id"]).groupBy(*key).agg(F.min("story_order").alias("truth"))
    bad = _named(unmarked(g.mentions).join(truth, key).where("story_order > truth"), g, "from_id").withColumn("character_id", F.col("from_id"))
    say_ = say("캐릭터 '", F.col("character_name"), "'이(가) 진실 인지(story_order=", F.col("truth"), ") 후에도 거짓 사실을 언급(story_order=", F.col("story_order"), ")")
    return violations(bad, "D13", "deception", "critical", say_, 0.9, {"truth_learned_at": "truth", "false_mention_at": "story_order"}, dialogue="dialogue_text")


def believed_lies(g: Graph) -> DataFrame:
    """A false fact is learned as true; of several times the last written counts."""
    b = unmarked(g.learns).where("coalesce(believed_true, true) AND story_order IS NOT NULL").join(_false_facts(g), ["work_id", "to_id"])
    bad = b.groupBy("work_id", "from_id", "to_id").agg(F.max_by("story_order", "seq").alias("at"), F.first("content").alias("content"), F.min("seq").alias("seq"))
    bad = _named(bad, g, "from_id").withColumn("character_id", F.col("from_id"))
    say_ = say("캐릭터 '", F.col("character_name"), "'이(가) 거짓 사실을 진실로 학습(story_order=", F.col("at"), ")")
    return violations(bad, "D14", "deception", "minor", say_, 0.55, {"fact_id": "to_id", "believed_true_at": "at", "fact": F.substring("content", 1, 100)}, True, "unreliable_narrator", dialogue="content")


def broken_prohibitions(g: Graph, respect_intent: bool = False) -> DataFrame:
    """An event does what a participant's trait, or a fact that names one, forbids.

    A trait or fact reports an event by its first keyword there, and each character and keyword is reported once, in the
    order of events, participants, traits before facts. Intent marks are ignored unless ``respect_intent``.
    """
    t = g.traits.where(T.is_prohibitive("value")).select("work_id", F.col("id").alias("to_id"), "key", "value", F.coalesce("is_immutable", F.lit(False)).alias("fixed")).dropDuplicates(["work_id", "to_id"])
    has = unmarked(g.has_trait) if respect_intent else g.has_trait
    traits = has.join(t, ["work_id", "to_id"]).select("work_id", F.col("from_id").alias("cid"), "key", "value", "fixed", F.lit(0).alias("rank"), F.col("seq").alias("order"), T.subject_keywords("value").alias("kws"))
    names = name_ids(g)
    f = g.facts.where(T.is_prohibitive("content")).select("work_id", "content", "seq", F.struct("content", "seq").alias("id"), T.subject_keywords("content").alias("kws"))
    order = g.characters.groupBy("work_id", "name").agg(F.min("seq").alias("named"))
    inside = names_in(f.select("work_id", "id", F.col("content").alias("text")), order).join(order, ["work_id", "name"])
    named = _first(inside.select("work_id", "id", "name", "named"), ["work_id", "id"], "named", "name")
    words = f.select("work_id", "id", F.posexplode("kws").alias("pos", "name")).join(names.select("work_id", "name"), ["work_id", "name"], "left_anti")
    words = words.groupBy("work_id", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "name")))["name"].alias("kws"))  # names are no keywords
    f = f.drop("kws").join(words, ["work_id", "id"]).join(named.drop("named"), ["work_id", "id"], "left").withColumn("name", F.coalesce("name", F.nullif(F.regexp_extract("content", "([가-힣A-Za-z0-9]+)", 1), F.lit(""))))
    facts = f.join(names.withColumnRenamed("id", "cid"), ["work_id", "name"]).select("work_id", "cid", F.lit("fact").alias("key"), F.col("content").alias("value"), F.lit(False).alias("fixed"), F.lit(1).alias("rank"), F.col("seq").alias("order"), "kws")
    # of a character's rules with the same keywords, and of its events with the same text, only the first can be reported
    rules = _first(traits.union(facts).where(F.size("kws") > 0), ["work_id", "cid", "kws"], "rank", "order", "key", "value")
    cast = g.events.select("work_id", "id", "description", "story_order", "discourse_order", F.col("seq").alias("seq"), F.posexplode("characters_involved").alias("pos", "name"))
    cast = cast.where("description IS NOT NULL").join(names.withColumnRenamed("id", "cid"), ["work_id", "name"])
    cast = _first(cast.select("work_id", "cid", "description", "story_order", "discourse_order", "seq", "pos", "name"), ["work_id", "cid", "description"], "seq", "pos")
    hits = cast.join(rules, ["work_id", "cid"]).withColumn("kw", F.expr("try_element_at(filter(kws, k -> contains(description, k)), 1)")).where("kw IS NOT NULL")
    bad = _first(hits.select("work_id", "cid", "kw", "key", "value", "fixed", "rank", "order", "description", "story_order", "discourse_order", "seq", "pos", "name"), ["work_id", "cid", "kw"], "seq", "rank", "pos", "order")
    bad = _named(bad, g, "cid").withColumns({"character_id": F.col("cid"), "at": F.coalesce(F.nullif("story_order", F.lit(0.0)), "discourse_order")})
    fixed, what = F.col("fixed"), F.when(F.col("rank") == 0, F.concat_ws(": ", "key", "value")).otherwise(F.substring("value", 1, 50))
    say_ = say("캐릭터 '", F.col("character_name"), "'의 특성 '", what, "'을(를) 위반하는 행동 발생(story_order=", F.col("at"), "): ", F.substring("description", 1, 80))
    return violations(bad, "D15", "trait", F.when(fixed, "critical").otherwise("major"), say_, F.when(fixed, 0.85).otherwise(0.7), {"trait_key": "key", "trait_value": "value", "matched_keyword": "kw"}, ~fixed, "intentional_change", dialogue="description")


def constraints(g: Graph) -> DataFrame:
    """(work_id, fact_id, content, kws, kind, value, unit, order): the numeric rules of all facts."""
    return g.facts.select("work_id", F.col("id").alias("fact_id"), "content", T.subject_keywords("content").alias("kws"), F.col("seq").alias("order"), F.col("chunk_id").alias("fact_chunk"), F.posexplode(T.fact_constraints("content")).alias("nth", "c")).select("*", "c.kind", F.col("c.value").alias("least"), "c.unit").drop("c")


def _first_below(hits: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, of, n): for each different ``of`` of ``asked`` the least n of the ``hits`` (keys, of, n) of its keys whose ``of`` is smaller.

    Both are aggregated to one row for each value of ``of`` first, so a key has no more rows than it has different values.
    """
    least = hits.groupBy(*keys, "of").agg(F.min("n").alias("n")).withColumn("asks", F.lit(1))
    rows = least.unionByName(asked.select(*keys, "of").distinct().withColumns({"n": F.lit(None).cast("long"), "asks": F.lit(0)}))
    w = Window.partitionBy(*keys).orderBy("of", "asks").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n", F.min("n").over(w)).where("asks = 0 AND n IS NOT NULL").select(*keys, "of", "n")


def _keyed(rules: DataFrame, few: int) -> DataFrame:
    """Rules with a row for each keyword ``word``; those of ``few`` keywords or fewer are about every text and have one empty word."""
    return rules.withColumn("word", F.explode(F.when(F.size("kws") <= few, F.array(F.lit(""))).otherwise(F.col("kws"))))


def broken_numbers(g: Graph) -> DataFrame:
    """An elapsed time or hour in an event or another fact breaks a numeric rule; once for each fact, kind and value.

    Texts that hold a keyword and a value of the rule's kind and unit are not paired with the rules: for each keyword and value the first
    text in order is kept, and a rule takes the first among its keywords of all values that break it. A rule without
    keywords is about every text. Only a rule whose first text is its own fact goes through the texts of that keyword. Of
    texts with one place in the order the one with the smaller id, then text, counts.
    """
    at = F.coalesce(F.nullif("story_order", F.lit(0.0)), F.nullif("discourse_order", F.lit(0.0)), F.lit(0.0))
    texts = g.events.select("work_id", F.col("id").alias("text_id"), F.col("description").alias("txt"), at.alias("at"), F.lit(0).alias("src"), "seq", "chunk_id")
    texts = texts.union(g.facts.select("work_id", "id", "content", F.coalesce(F.nullif("established_order", F.lit(0.0)), F.lit(0.0)), F.lit(1), "seq", "chunk_id")).where("text_id IS NOT NULL")
    values = texts.select("*", F.posexplode(T.event_values("txt")).alias("vpos", "v")).select("*", F.when(F.col("v.kind") == "clock_time", "hour").otherwise("lasting").alias("axis"), F.col("v.value").alias("found"), F.col("v.unit").alias("unit")).drop("v")
    values = stored(numbered(stored(values), ["src", "seq", "vpos", "text_id", "txt", "at", "chunk_id"], ["work_id"]))
    rules = constraints(g).withColumn("axis", F.when(F.col("kind") == "lockout_after_hour", "hour").otherwise("lasting"))
    # a rule is broken by values below its own, or by hours from its own on, that is by negative hours below one more than its own
    hour = F.col("axis") == "hour"
    words = stored(_keyed(rules, 0).withColumn("of", F.when(hour, 1 - F.col("least")).otherwise(F.col("least")).cast("long")).where("of IS NOT NULL"))
    told = values.select("work_id", "axis", "unit", "n", "text_id", F.sha2("txt", 256).alias("text"), F.when(hour, -F.col("found")).otherwise(F.col("found")).cast("long").alias("of")).where("of IS NOT NULL")
    held = stored(holding(values.select(F.sha2("txt", 256).alias("id"), F.col("txt").alias("text")).distinct(), words.where("word <> ''")).select(F.col("id").alias("text"), "word"))
    by = ["work_id", "axis", "unit", "word"]
    asked = words.select(by).distinct()

    def hits(told: DataFrame) -> DataFrame:
        every = told.join(asked.where("word = ''"), by[:3])
        return told.join(held, "text").select(every.columns).join(asked, by, "left_semi").unionByName(every)

    least = hits(told.groupBy("work_id", "axis", "unit", "text", "of").agg(F.min("n").alias("n")))
    first = stored(words.join(_first_below(least, words, by), [*by, "of"]).join(values.select("work_id", "n", "text_id", "txt", "at", "found", "src", "seq", "chunk_id"), ["work_id", "n"]))
    own = first.where("text_id = fact_id").select("work_id", "axis", "unit", "word", "of", "fact_id").distinct()
    if not own.isEmpty():
        others = hits(told).withColumnRenamed("of", "below").join(own, by).where("below < of AND text_id <> fact_id").groupBy(*by, "of", "fact_id").agg(F.min("n").alias("n"))
        other = words.join(others, [*by, "of", "fact_id"]).join(values.select("work_id", "n", "text_id", "txt", "at", "found", "src", "seq", "chunk_id"), ["work_id", "n"])
        first = first.where("text_id <> fact_id").unionByName(other)
    bad = _first(first.select("work_id", "fact_id", "kind", "least", "unit", "content", "text_id", "txt", "at", "found", "src", "seq", "n", "order", "nth", F.coalesce("fact_chunk", "chunk_id").alias("chunk_id")), ["work_id", "fact_id", "kind", "least"], "src", "seq", "order", "nth", "n")
    n, u, f = F.col("least"), F.col("unit"), F.col("found")
    tail = ["만에 이동(story_order=", F.col("at"), "): ", F.substring("txt", 1, 80)]
    say_ = (
        F.when(F.col("kind") == "min_duration", say("세계 규칙 위반 — 최소 ", n, u, " 소요 구간을 ", f, u, " ", *tail))
        .when(F.col("kind") == "min_duration_general", say("세계 규칙 위반 — 최소 ", n, u, " 필요한 과정이 ", f, u, " 만에 완료(story_order=", *tail[1:]))
        .otherwise(say("세계 규칙 위반 — ", n, "시 이후 봉쇄 구역에 ", f, "시 이동/진입(story_order=", *tail[1:]))
    )
    sure = F.col("kind") != "min_duration_general"
    return violations(bad, "D17", "timeline", F.when(sure, "critical").otherwise("major"), say_, F.when(sure, 0.95).otherwise(0.75), {"fact": "content", "fact_id": "fact_id", "compared_text": F.substring("txt", 1, 100), "kind": "kind", "value": "least", "found": "found"}, ~sure, "timeline_ambiguity", dialogue="txt")


def _consecutive(timed: DataFrame, longest: int) -> DataFrame:
    """Gaps between consecutive rows of ``timed`` (work_id, at, seq, description, chunk_id, ts) above zero and below ``longest`` minutes.

    (work_id, place, of, description, at, seq, chunk_id, before): place grows in the order of a work, of is the gap in minutes and
    before the earlier description. Rows are sorted over ranges and held against the one before as they pass; only the first and the last
    row of each range meet those of the next.
    """
    rows = timed.orderBy("work_id", "at", "seq", "description").select("work_id", "at", "seq", "description", "chunk_id", F.col("ts").cast("long").alias("ts"))
    texts = StructType([*(rows.schema[c] for c in ("work_id", "at", "seq", "description", "chunk_id")), StructField("before", StringType())])
    schema = StructType([*texts, *(StructField(c, LongType()) for c in ("place", "of", "ts", "end"))])

    def passed(batches):
        last, at = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            table, place = pa.Table.from_batches([batch]), pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            both = pa.concat_tables([table.slice(0, 1) if last is None else last, table.slice(0, table.num_rows - 1)]).combine_chunks()
            of = pc.subtract(table["ts"], both["ts"])
            # the first row of a range is held against itself, so its gap is zero
            near = pc.and_(pc.equal(table["work_id"], both["work_id"]), pc.and_(pc.greater(of, 0), pc.less(of, longest)))
            found = table.append_column("before", both["description"]).append_column("place", place).append_column("of", of)
            kept = [found.filter(near).append_column("end", pa.array([0] * pc.sum(near).as_py(), pa.int64()))] if pc.any(near).as_py() else []
            if last is None:
                kept.append(found.slice(0, 1).append_column("end", pa.array([1], pa.int64())))
            last, tail = table.slice(table.num_rows - 1), found.slice(table.num_rows - 1)
            for t in kept:
                yield from t.select(schema.names).combine_chunks().to_batches()
        if last is not None:
            yield from tail.append_column("end", pa.array([2], pa.int64())).select(schema.names).combine_chunks().to_batches()

    with shuffles_freed(timed.sparkSession):
        found = stored(rows.mapInArrow(passed, schema))
    of_range = Window.orderBy("place", "end")  # two rows for each range
    ends = found.where("end > 0").withColumns({to: F.lag(c).over(of_range) for to, c in (("before", "description"), ("work_id0", "work_id"), ("ts0", "ts"))})
    ends = ends.where("end = 1 AND work_id = work_id0").withColumn("of", F.col("ts") - F.col("ts0")).where((F.col("of") > 0) & (F.col("of") < longest))
    columns = ["work_id", "place", "of", "description", "at", "seq", "chunk_id", "before"]
    return found.where("end = 0").select(columns).union(ends.select(columns))


def broken_gaps(g: Graph) -> DataFrame:
    """Consecutive events with clock times are closer than a movement rule allows; once for each fact, kind and value.

    Hours of a rule count sixty minutes; seconds are compared as if they were minutes, as the rule has always done. Gaps and rules are
    not paired: for each keyword and length of time the first gap in order is kept, and a rule takes the first among its
    keywords of all shorter ones. A rule of two keywords or fewer is about every gap. A gap that is as long as the longest rule
    breaks none and is never written.

    Works are taken in so many slices that about ``SLICE`` bytes of input go to each; a slice's events and shuffle files are deleted before the
    next one's are made, so that disk holds the events of one slice and the short gaps of all.
    """
    spark = g.events.sparkSession
    at = F.coalesce(F.nullif("story_order", F.lit(0.0)), F.nullif("discourse_order", F.lit(0.0)), F.lit(0.0))
    rules = constraints(g).where("kind = 'min_duration'").withColumn("minutes", F.when(F.col("unit") == "시간", F.col("least") * 60).otherwise(F.col("least")))
    words = stored(_keyed(rules, 2).withColumn("of", F.col("minutes").cast("long")).where("of IS NOT NULL").select("work_id", "fact_id", "kind", "least", "unit", "content", "minutes", "order", "nth", "word", "of"))
    longest = words.agg(F.max("of")).first()[0] or 0
    slices, gaps = 1 + input_bytes(g.events) // SLICE, None
    told = g.events.where(F.col("work_id").isNotNull() & F.rlike("description", F.lit(T.HOUR)))
    for i in range(slices):
        own = told.where(F.pmod(F.xxhash64("work_id"), F.lit(slices)) == i) if slices > 1 else told
        with shuffles_freed(spark):
            timed = stored(own.select("work_id", at.alias("at"), "seq", "description", "chunk_id", T.timestamp_minutes("description").alias("ts")))
        one = _consecutive(timed.where("ts IS NOT NULL"), longest)
        dropped(timed)
        gaps = one if gaps is None else gaps.unionByName(one)
    by = ["work_id", "word"]
    asked = words.select(by).distinct()
    # a gap holds the words of both of its texts
    sha = F.unhex(F.sha2("text", 256))
    texts = gaps.select("work_id", "of", "place", F.explode(F.array("before", "description")).alias("text"))
    held = holding(texts.select(sha.alias("id"), "text").distinct(), words.where("word <> ''")).select(F.col("id").alias("text"), "word")
    each = texts.groupBy("work_id", "of", sha.alias("text")).agg(F.min("place").alias("n"))
    every = gaps.groupBy("work_id", "of").agg(F.min("place").alias("n")).join(asked.where("word = ''"), "work_id")
    hits = each.join(held, "text").select("work_id", "word", "of", "n").join(asked, by, "left_semi").unionByName(every.select("work_id", "word", "of", "n"))
    with shuffles_freed(spark):
        least = stored(_first_below(hits, words, by))
        first = words.join(least, [*by, "of"]).select("work_id", "fact_id", "kind", "least", "unit", "content", "minutes", "n", "order", "nth")
        first = stored(_first(first, ["work_id", "fact_id", "kind", "least"], "n", "order", "nth"))
    bad = first.join(gaps.withColumnsRenamed({"place": "n", "of": "gap"}), ["work_id", "n"])
    say_ = say("세계 규칙 위반 — 최소 ", F.col("least"), F.col("unit"), " 소요 구간을 ", F.col("gap"), "분 만에 이동(story_order=", F.col("at"), "): ", F.substring("description", 1, 60))
    return violations(bad, "D18", "timeline", "critical", say_, 0.95, {"fact": "content", "fact_id": "fact_id", "time_diff_min": "gap", "required_min": "minutes"}, dialogue="description")


RULES = [mention_before_learning, taught_by_ignorant, appears_after_death, acts_after_death, two_places, resurrections, relationship_conflicts, trait_conflicts, emotion_flips, shared_items, repossessions, unexplained_transfers, lies_after_truth, believed_lies, broken_prohibitions, broken_numbers, broken_gaps]


def scan(g: Graph) -> DataFrame:
    """All rules' violations, with ``rule_order`` for the order among rules: a stored table, for which one rule runs after another."""
    return stored_each(g.events.sparkSession, (rule(g).withColumn("rule_order", F.lit(i)) for i, rule in enumerate(RULES)))
