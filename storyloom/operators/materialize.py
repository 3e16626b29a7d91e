"""Materialisation: normalised tables to the vertices and edges of a graph. Ids are names made from work and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators.alike import alike_pairs
from storyloom.operators.firstfit import first_fit
from storyloom.operators.holding import names_in
from storyloom.plans.graph import Graph
from storyloom.plans.numbering import numbered
from storyloom.plans.stored import stored

#: Words by which facts and events are read.
TIME_JUMPS = "전|후|년 전|일 전|며칠 후|그날 밤|그때|과거에|회상|flashback|그 무렵"
DEATH = "사망|죽|숨졌|시체|피살|살해|사망한 상태|암살|익사|사고사|전사|처형|사형|사망 처리|사망 판정|사망자 등록|사사"
IMMUTABLE = "절대|극혐|일절|혐오|불변|태생|선천|혈액형|입에 대지"
UNIQUE = "하나뿐|유일|단 하나|오직 하나|1개뿐|한 개뿐"


def _id(prefix: str, *cols) -> Column:
    return F.concat(F.lit(prefix), F.hex(F.xxhash64(*cols)))


def upserted(existing: DataFrame, found: DataFrame, key: str, prefix: str) -> DataFrame:
    """Found rows with the id of the existing vertex of the same key in the work, or a new one."""
    old = existing.groupBy("work_id", key).agg(F.min_by("id", "seq").alias("_old"))
    return found.join(old, ["work_id", key], "left").withColumns({"id": F.coalesce("_old", _id(prefix, "work_id", key)), "is_new": F.col("_old").isNull()}).drop("_old")


def name_dictionary(chars: DataFrame) -> DataFrame:
    """(work_id, name, cid) of all names and aliases; of equal ones a canonical name, then the last, counts."""
    names = chars.select("work_id", "id", "seq", F.lit(1).alias("own"), "name").union(chars.select("work_id", "id", "seq", F.lit(0), F.explode("aliases")))
    return names.where("name <> ''").groupBy("work_id", "name").agg(F.max_by("id", F.struct("own", "seq")).alias("cid"))


def resolved(rows: DataFrame, names: DataFrame, column: str, as_: str) -> DataFrame:
    """Rows whose name in ``column`` is known, with its character id; the others go."""
    return rows.join(names.select("work_id", F.col("name").alias(column), F.col("cid").alias(as_)), ["work_id", column])


def time_axes(events: DataFrame) -> DataFrame:
    """Events with a discourse_order get a story_order like it, but for those with a word of a time jump, where it is open."""
    jump = F.rlike("description", F.lit(TIME_JUMPS))
    return events.withColumns({"is_linear": ~jump, "story_order": F.when(~jump, F.col("discourse_order"))})


def highest_orders(g: Graph) -> DataFrame:
    """work_id, n: how many tenths the orders of a graph have come to in each work."""
    own = [g.facts.select("work_id", F.col("established_order").alias("o")), *(t.select("work_id", F.col("discourse_order").alias("o")) for t in (g.events, g.feels, g.learns, g.mentions, g.possesses, g.loses, g.related))]
    out = own[0]
    for t in own[1:]:
        out = out.union(t)
    return out.groupBy("work_id").agg(F.round(F.coalesce(F.max("o"), F.lit(0.0)) * 10).cast("long").alias("n"))


def ordered(steps: tuple[tuple[DataFrame, str, str], ...], start: DataFrame) -> list[DataFrame]:
    """The rows of all steps (rows, and two columns of theirs that order them) with ``discourse_order``: one running count of
    tenths for each work over all steps, one step after the other, that goes on from ``start`` (work_id, n).

    All steps are sorted and numbered in one pass over ranges, so a work of any size is spread over tasks.
    """
    every = None
    for i, (t, first, then) in enumerate(steps):
        one = t.select("work_id", F.lit(i).alias("step"), F.col(first).cast("long").alias("o1"), F.col(then).cast("string").alias("o2"), F.struct(*t.columns).alias(f"r{i}"))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    n = numbered(every, ["step", "o1", "o2"], ["work_id"], "nth").join(start, "work_id", "left")
    n = stored(n.withColumn("discourse_order", F.round((F.coalesce("n", F.lit(0)) + F.col("nth")) * 0.1, 4)))
    return [n.where(F.col("step") == i).select(f"r{i}.*", "discourse_order") for i in range(len(steps))]


def named_deaths(facts: DataFrame, chars: DataFrame) -> DataFrame:
    """For each fact that tells of a death the first character, in order of seq, of whom a name or alias is in it:
    work_id, fact_id, cid, name (canonical), content, seq.

    Facts without a word of death never meet the names, and the others only those that they hold.
    facts: work_id, id, content, seq; chars: work_id, id, name, aliases, seq.
    """
    told = facts.where(F.rlike("content", F.lit(DEATH))).select("work_id", F.col("id").alias("fact_id"), "content", "seq")
    spelt = chars.select("work_id", F.col("id").alias("cid"), "name", F.col("seq").alias("rank"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelt")).where("spelt <> ''")
    held = names_in(told.select("work_id", F.col("fact_id").alias("id"), F.col("content").alias("text")), spelt.select("work_id", F.col("spelt").alias("name"))).select("work_id", F.col("id").alias("fact_id"), F.col("name").alias("spelt"))
    hit = held.join(spelt, ["work_id", "spelt"]).join(told, ["work_id", "fact_id"])
    return hit.groupBy("work_id", "fact_id").agg(F.min_by(F.struct("cid", "name", "content", "seq"), F.struct("rank", "name", "cid")).alias("x")).select("work_id", "fact_id", "x.*")


def conflict_confirmations(conflicts: DataFrame) -> DataFrame:
    """Conflicts of sources (work_id, topic, conflicting_values, descriptions) as rows for ``create_confirmations``: one
    for each, which asks for the source that holds, with the text of each source in order as excerpts."""
    excerpts = F.transform(F.array_sort("descriptions"), lambda d: F.struct(d["chunk"].alias("source_name"), F.lit("").alias("source_location"), d["v"].alias("text")))
    return conflicts.select(
        "work_id", _id("confirmation-", "work_id", "topic").alias("id"), F.lit("source_conflict").alias("confirmation_type"),
        F.concat(F.lit("소스 충돌: 'fact:"), "topic", F.lit("'의 정본을 선택하세요.")).alias("question"), F.concat(F.lit("충돌 값: "), F.array_join("conflicting_values", ", ")).alias("context_summary"),
        excerpts.alias("source_excerpts"), F.array().cast("array<string>").alias("related_entity_ids"),
    )


def link_facts(knowledge: DataFrame, facts: DataFrame, least: float = 0.5) -> DataFrame:
    """Each knowledge row's fact: of equal content, else the most alike by character pairs (``least`` or more, the earliest on
    ties), else a new one, which later rows may find: work_id, k, fact_id, content, is_new (on the row that makes the fact).

    Equal contents are joined. Of the rest only contents that are alike meet, by their rarest character pairs. Which of them become
    facts is an ordered first fit among contents that no fact is like; all else follows by joins.
    knowledge: work_id, k (its place in the work), fact_content; facts: work_id, id, content, place (what orders them in the work).
    """
    known = facts.groupBy("work_id", F.col("content").alias("fact_content")).agg(F.min_by("id", "place").alias("fact_id"))
    k = knowledge.select("work_id", "k", "fact_content").join(known, ["work_id", "fact_content"], "left")
    exact = k.where("fact_id IS NOT NULL").select("work_id", "k", "fact_id", F.col("fact_content").alias("content"), F.lit(False).alias("is_new"))
    open_ = k.where("fact_id IS NULL")
    asked = open_.groupBy("work_id", F.col("fact_content").alias("content")).agg(F.min("k").alias("at")).withColumns({"id": _id("fact-", "work_id", "content"), "asks": F.lit(True), "place": F.lit(None).cast(facts.schema["place"].dataType)})
    base = facts.join(asked.select("work_id").distinct(), "work_id", "left_semi").groupBy("work_id", "content").agg(F.min_by("id", "place").alias("id"), F.min("place").alias("place")).withColumns({"at": F.lit(-1).cast("long"), "asks": F.lit(False)})
    texts = numbered(asked.unionByName(base), ["work_id", "asks", "place", "at"], name="nth").drop("place").withColumnRenamed("nth", "place")
    pairs = stored(alike_pairs(texts.withColumn("pairs", T.fact_bigrams("content")), "pairs", least))
    own = texts.select("work_id", F.col("place").alias("a"), "id", "at", "asks")
    near = pairs.join(own, "a")
    settled = near.where("NOT asks").select("b").distinct()  # a fact is like them, so they never become one
    loose = pairs.join(near.where("asks").select("a", "b"), ["a", "b"], "left_semi").join(settled, "b", "left_anti").join(settled.toDF("a"), "a", "left_anti")
    gone = first_fit(loose.select("a", "b")).union(settled)
    made = texts.where("asks").join(gone.select(F.col("b").alias("place")), "place", "left_anti").select("work_id", "content", "id", "at")
    # what a content may be linked to: facts, and contents that became one before the row; score first, then the earliest
    option = F.struct("score", (-F.col("a")).alias("early"), "id", F.col("at").alias("since"))
    options = near.where("NOT asks").unionByName(near.where("asks").join(made.select("work_id", "id"), ["work_id", "id"], "left_semi").select(near.columns)).groupBy("b").agg(F.collect_list(option).alias("options"))
    asking = texts.where("asks").select("work_id", "content", F.col("place").alias("b")).join(options, "b", "left").join(made.select("work_id", "content", F.col("id").alias("own"), "at"), ["work_id", "content"], "left")
    rows = open_.select("work_id", "k", F.col("fact_content").alias("content")).join(asking, ["work_id", "content"])
    best = F.array_max(F.filter("options", lambda o: o["since"] < F.col("k")))["id"]
    linked = rows.select("work_id", "k", F.coalesce("own", best).alias("fact_id"), "content", F.coalesce(F.col("k") == F.col("at"), F.lit(False)).alias("is_new"))
    return exact.unionByName(linked)


def materialize(spark: SparkSession, n: dict[str, DataFrame], existing: Graph | None = None) -> Graph:
    """What normalised tables (characters, facts, events, traits, emotions, knowledge, items, relationships) add to a graph.

    New vertices and all edges are given; characters, facts and items that ``existing`` holds keep their ids and are not given
    again, but for items that have become unique. Orders go on from those of ``existing``: over new facts, events, deaths that
    facts tell of, feelings, knowledge (a fact it makes before its own), items and relations.
    """
    old = existing or Graph.of(spark)
    by = ["seq", "source_chunk_id"]
    chars = upserted(old.characters, n["characters"], "name", "char-").withColumn("chunk_id", F.element_at("merged_from", 1)["source_chunk_id"])
    names = name_dictionary(chars.select("work_id", "id", "seq", "name", "aliases").unionByName(old.characters.select("work_id", "id", "seq", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))))
    facts = upserted(old.facts, n["facts"], "content", "fact-").withColumns({"is_true": F.lit(True), "is_secret": F.lit(False), "source_chunk_id": F.element_at("merged_from", 1)["source_chunk_id"]})
    facts = stored(facts.withColumn("chunk_id", F.col("source_chunk_id")).drop("merged_from"))
    deaths = named_deaths(facts, chars).withColumn("source_chunk_id", F.col("fact_id"))
    feels = resolved(resolved(n["emotions"], names, "from_char", "from_id"), names, "to_char", "to_id")
    know = numbered(resolved(n["knowledge"], names, "character_name", "from_id"), [*by, "event_type", "fact_content", "from_id"], ["work_id"], "k")
    known = old.facts.withColumn("late", F.lit(0)).unionByName(facts.where("is_new").withColumn("late", F.lit(1)), allowMissingColumns=True).select("work_id", "id", "content", F.struct("late", "seq", "id").alias("place"))
    linked = stored(know.join(link_facts(know, known).withColumnRenamed("fact_id", "to_id"), ["work_id", "k"]))
    drawn = linked.withColumn("edge", F.explode(F.when(F.col("is_new"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    it = resolved(n["items"], names, "character_name", "from_id")
    rel = resolved(resolved(n["relationships"], names, "char_a", "from_id"), names, "char_b", "to_id").withColumn("relationship_type", T.relationship_type("type_hint"))
    steps = (facts.where("is_new"), *by), (n["events"], *by), (deaths, "seq", "fact_id"), (feels, *by), (drawn, "k", "edge"), (it, *by), (rel, *by)
    new, ev, deaths, feels, drawn, it, rel = ordered(steps, highest_orders(old))
    ev = time_axes(ev).withColumns({"id": _id("event-", "work_id", "description", "location", "discourse_order"), "chunk_id": F.col("source_chunk_id")})
    dead_events = resolved(ev.where(F.col("status_char").isNotNull() & ((F.col("event_type") == "death") | F.rlike("description", F.lit(DEATH)))), names, "status_char", "from_id")
    at = F.coalesce(F.nullif("story_order", F.lit(0.0)), F.nullif("discourse_order", F.lit(0.0)), F.lit(0.0))
    deaths = deaths.withColumns({"id": _id("event-", "work_id", "fact_id", F.lit("death"), "discourse_order"), "story_order": F.lit(0.0)})
    told = deaths.select("work_id", "id", F.col("content").alias("description"), F.lit("death").alias("event_type"), "story_order", "discourse_order", F.lit(True).alias("is_linear"), F.array("name").alias("characters_involved"), "seq")
    statuses = dead_events.select("work_id", "from_id", F.col("id").alias("to_id"), at.alias("story_order"), "discourse_order", "chunk_id", "seq").unionByName(deaths.select("work_id", F.col("cid").alias("from_id"), F.col("id").alias("to_id"), "story_order", "discourse_order", F.lit(None).cast("string").alias("chunk_id"), "seq")).withColumn("status_type", F.lit("dead"))
    tr = resolved(n["traits"], names, "character_name", "from_id").withColumns({"id": _id("trait-", "work_id", "from_id", "key", "value", "seq", "source_chunk_id"), "is_immutable": F.rlike(F.concat_ws(" ", "key", "value"), F.lit(IMMUTABLE)), "chunk_id": F.col("source_chunk_id"), "category": F.col("category_hint")})
    same = {"story_order": F.col("discourse_order"), "chunk_id": F.col("source_chunk_id")}
    feels = feels.withColumns({"intensity": F.lit(0.5)} | same)
    edges = drawn.where("edge = 1").withColumns({"believed_true": F.lit(True)} | same)
    new_facts = drawn.where("edge = 0").select("work_id", F.col("to_id").alias("id"), "content", F.lit("event_fact").alias("category"), F.lit(True).alias("is_true"), F.lit(False).alias("is_secret"), F.col("discourse_order").alias("established_order"), F.col("source_chunk_id").alias("chunk_id"), "seq")
    full = new.select("work_id", "id", "content", "category", "is_true", "is_secret", F.col("discourse_order").alias("established_order"), "chunk_id", "seq").unionByName(new_facts)
    it = it.withColumns(same)
    things = upserted(old.items, it.groupBy("work_id", F.col("item_name").alias("name")).agg(F.min_by("source_chunk_id", "seq").alias("chunk_id"), F.min("seq").alias("seq")), "name", "item-")
    every = old.items.select("work_id", "id", "name", F.coalesce("is_unique", F.lit(False)).alias("was")).unionByName(things.where("is_new").select("work_id", "id", "name", F.lit(False).alias("was")))
    unique = unique_items(every.where("NOT was"), old.facts.select("work_id", "content").union(full.select("work_id", "content")))
    given = things.where("is_new").select("work_id", "id", "name", "chunk_id", "seq").join(unique.withColumn("is_unique", F.lit(True)), ["work_id", "id"], "left").withColumn("is_unique", F.coalesce("is_unique", F.lit(False)))
    become = old.items.join(unique, ["work_id", "id"], "left_semi").withColumn("is_unique", F.lit(True))
    own = it.join(things.select("work_id", F.col("name").alias("item_name"), F.col("id").alias("to_id")), ["work_id", "item_name"])
    return Graph.of(
        spark,
        characters=chars.where("is_new"), facts=full, events=ev.unionByName(told, allowMissingColumns=True), traits=tr, items=given.unionByName(become, allowMissingColumns=True), statuses=statuses, feels=feels,
        related=rel.withColumn("chunk_id", F.col("source_chunk_id")), learns=edges.where("event_type = 'learns'"), mentions=edges.where("event_type = 'mentions'"), has_trait=tr.withColumn("to_id", F.col("id")),
        possesses=own.where("action <> 'loses'"), loses=own.where("action = 'loses'"),
    )


def unique_items(items: DataFrame, facts: DataFrame) -> DataFrame:
    """work_id, id of the items whose name is in a fact of their work that says there is only one.

    Facts without a word for it never meet a name, and names are looked up by an index of the facts' tokens.
    """
    said = facts.where(F.rlike("content", F.lit(UNIQUE))).select("work_id", F.xxhash64("content").alias("id"), F.col("content").alias("text")).distinct()
    named = items.where("name <> ''")
    return named.join(names_in(said, named).select("work_id", "name").distinct(), ["work_id", "name"], "left_semi").select("work_id", "id").distinct()


def lineage(g: Graph) -> DataFrame:
    """A row for each vertex with the chunk it comes from."""
    out = None
    for n in ("characters", "facts", "events", "traits", "items"):
        one = g.tables()[n].select("work_id", F.lit(n).alias("label"), F.col("id").alias("from_id"), "chunk_id")
        out = one if out is None else out.union(one)
    return out.where("chunk_id IS NOT NULL")


def created(g: Graph) -> DataFrame:
    """How many vertices and edges of each kind each work has."""
    out = None
    for n, t in g.tables().items():
        one = t.groupBy("work_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(n))
        out = one if out is None else out.union(one)
    return out
