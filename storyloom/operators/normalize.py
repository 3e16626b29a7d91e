"""Normalisation: raw entities of all chunks merged into one row for each entity of a work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.functions import text as T
from storyloom.operators.alike import alike_pairs, matching_pairs
from storyloom.operators.firstfit import first_fit
from storyloom.plans.numbering import numbered
from storyloom.plans.stored import stored


def characters(raw: DataFrame) -> DataFrame:
    """Names that differ only in blanks and case are one character: name is the first seen, aliases the other spellings.

    raw: work_id, name, source_chunk_id, seq; out: work_id, name, aliases, merged_from, seq.
    """
    key = F.lower(F.regexp_replace("name", r"\s", ""))
    g = raw.groupBy("work_id", key.alias("_k")).agg(F.min_by("name", "seq").alias("name"), F.collect_set("name").alias("_all"), F.array_sort(F.collect_list(F.struct("seq", "name", "source_chunk_id"))).alias("merged_from"), F.min("seq").alias("seq"))
    return g.select("work_id", "name", F.array_sort(F.array_remove("_all", F.col("name"))).alias("aliases"), "merged_from", "seq")


def absorb_aliases(raw: DataFrame) -> DataFrame:
    """Characters (work_id, name, aliases, seq) whose name is an alias of another are absorbed by it with their aliases.

    A name that has aliases itself stays its own owner; of several owners of an alias the last counts. One step, not transitive.
    """
    named = raw.groupBy("work_id", "name").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("aliases"), F.min("seq").alias("seq"))
    owns = named.where("size(aliases) > 0").select("work_id", F.col("name").alias("owner"), "seq", F.explode("aliases").alias("name")).where("owner <> name")
    owner = owns.groupBy("work_id", "name").agg(F.max_by("owner", "seq").alias("owner"))
    to = named.join(owner, ["work_id", "name"], "left").withColumn("to", F.when((F.size("aliases") == 0) & F.col("owner").isNotNull(), F.col("owner")).otherwise(F.col("name")))
    g = to.groupBy("work_id", F.col("to").alias("_n")).agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), "aliases")))).alias("_all"), F.min("seq").alias("seq"))
    return g.select("work_id", F.col("_n").alias("name"), F.array_sort(F.array_remove("_all", F.col("_n"))).alias("aliases"), "seq")


def link_groups(groups: DataFrame, raw: DataFrame) -> DataFrame:
    """Supplied groups (work_id, name, aliases) linked to raw names by name or alias; groups without any go, and raw names in no group are added."""
    spelt = groups.select("work_id", F.col("name").alias("canonical"), "aliases", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    hit = raw.select("work_id", "name", "seq").join(spelt.dropDuplicates(["work_id", "name"]), ["work_id", "name"])
    linked = hit.groupBy("work_id", F.col("canonical").alias("name")).agg(F.first("aliases").alias("aliases"), F.min("seq").alias("seq"))
    alone = raw.join(spelt.select("work_id", "name"), ["work_id", "name"], "left_anti").groupBy("work_id", "name").agg(F.min("seq").alias("seq"))
    return linked.unionByName(alone.withColumn("aliases", F.array().cast("array<string>")).select("work_id", "name", "aliases", "seq"))


def merge_facts(raw: DataFrame, ratio: float = 0.90, least: float = 0.78) -> DataFrame:
    """Each fact joins the first representative that says the same: content, category, merged (ids of its facts), seq.

    Equal normal texts are one before any pair is compared. Representatives are taken in order within a work; a pair says the
    same if neither polarity nor numbers conflict, and the texts' matching ratio or the Jaccard similarity of their words
    is high enough. Pairs come from joins on rare words and rare character triples, and who is a representative is an ordered
    first fit over them, so no task holds a work. world_fact takes the first other category.
    raw: work_id, content, category_hint, source_chunk_id, seq.
    """
    t = raw.withColumns({"norm": T.normalize_text("content"), "kind": F.coalesce("category_hint", F.lit("world_fact"))})
    exact = t.groupBy("work_id", "norm").agg(F.min_by("content", "seq").alias("content"), F.array_sort(F.collect_list(F.struct("seq", "kind", "source_chunk_id"))).alias("members"), F.min("seq").alias("seq"))
    exact = numbered(exact, ["work_id", "seq", "norm"], name="place")
    words = exact.select("work_id", "place", F.lit(True).alias("asks"), T.semantic_tokens("content").alias("tokens"))
    near = alike_pairs(words, "tokens", least).select("a", "b").union(matching_pairs(exact.select("work_id", "place", F.col("norm").alias("text")), ratio)).distinct()
    said = exact.select("place", "content")
    both = near.join(said.toDF("a", "content_a"), "a").join(said.toDF("b", "content_b"), "b")
    same = stored(both.where(~(T.polarity_conflict("content_b", "content_a") | T.numeric_conflict("content_b", "content_a"))).select("a", "b"))
    gone = first_fit(same)
    to = same.join(gone, "b", "left_semi").join(gone.withColumnRenamed("b", "a"), "a", "left_anti").groupBy(F.col("b").alias("place")).agg(F.min("a").alias("head"))
    joined = exact.join(to, "place", "left").withColumn("head", F.coalesce("head", "place"))
    g = joined.groupBy("work_id", "head").agg(F.min_by("content", "seq").alias("content"), F.array_sort(F.flatten(F.collect_list("members"))).alias("members"), F.min("seq").alias("seq"))
    kinds = F.transform("members", lambda m: m["kind"])
    better = F.filter(kinds, lambda k: k != "world_fact")
    return g.select("work_id", "content", F.when(F.size(better) > 0, F.element_at(F.concat(better, F.array(F.lit("world_fact"))), 1)).otherwise("world_fact").alias("category"), F.col("members").alias("merged_from"), "seq")


def events(raw: DataFrame) -> DataFrame:
    """Events of the same trimmed description and place are one: participants in the order first seen, type and status of the first."""
    place = F.coalesce("location_hint", F.lit(""))
    order = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("characters_involved", F.array().cast("array<string>")).alias("who"))))
    g = raw.groupBy("work_id", T.strip("description").alias("description"), place.alias("location")).agg(order.alias("_o"), *(F.min_by(c, "seq").alias(c) for c in ("event_type", "status_char", "source_chunk_id")), F.min("seq").alias("seq"))
    return g.withColumn("characters_involved", F.array_distinct(F.flatten(F.col("_o.who")))).drop("_o")


def source_conflicts(facts: DataFrame) -> DataFrame:
    """Facts of different chunks whose polarity or numbers conflict, grouped by up to four shared words: values and the text of each source.

    Both tests need alike words, so only facts that share a word are paired. facts: work_id, content, source_chunk_id, seq.
    """
    f = facts.select("work_id", "content", F.col("source_chunk_id").alias("chunk"), "seq", T.semantic_tokens("content").alias("tokens"))
    w = f.select("*", F.explode("tokens").alias("t"))
    # alike pairs share 0.6 of their words without negations or numbers, so they meet among the rarest of each
    n = w.groupBy("work_id", "t").agg(F.count("*").alias("n"))
    ranked = w.join(n, ["work_id", "t"]).withColumn("_r", F.row_number().over(Window.partitionBy("work_id", "seq").orderBy("n", "t")))
    core, plain = F.filter("tokens", lambda t: ~t.isin(L.NEGATIONS)), F.filter("tokens", lambda t: ~F.rlike(t, F.lit(r"\p{Nd}")))
    near = ranked.where(F.col("_r") <= F.size("tokens") - F.ceil(F.least(F.size(core), F.size(plain)) * 0.6) + 1)
    a, b = (near.select("work_id", "t", *(F.col(c).alias(f"{c}_{s}") for c in ("content", "chunk", "seq", "tokens"))) for s in "ab")
    pairs = a.join(b, ["work_id", "t"]).where("seq_a < seq_b AND chunk_a <> chunk_b").drop("t").dropDuplicates(["work_id", "seq_a", "seq_b"])
    bad = pairs.where(T.polarity_conflict("content_a", "content_b") | T.numeric_conflict("content_a", "content_b"))
    core = lambda a: F.array_sort(F.filter(a, lambda t: ~t.isin(L.NEGATIONS)))
    common, either = core(F.array_intersect("tokens_a", "tokens_b")), core(F.array_union("tokens_a", "tokens_b"))
    shared = F.slice(F.when(F.size(common) > 0, common).when(F.size(either) > 0, either).otherwise(F.array(F.lit("general"))), 1, 4)
    both = bad.select("work_id", F.array_join(shared, "_").alias("topic"), F.explode(F.array(F.struct(F.col("content_a").alias("v"), F.col("chunk_a").alias("chunk")), F.struct(F.col("content_b").alias("v"), F.col("chunk_b").alias("chunk")))).alias("x"))
    g = both.groupBy("work_id", "topic").agg(F.array_sort(F.collect_set("x.v")).alias("conflicting_values"), F.array_sort(F.collect_set("x")).alias("descriptions"))
    return g.where("size(conflicting_values) >= 2")


def normalized(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw entities by kind with characters, facts and events merged, and the conflicts of sources among the facts."""
    return raw | {"characters": characters(raw["characters"]), "facts": merge_facts(raw["facts"]), "events": events(raw["events"]), "conflicts": source_conflicts(raw["facts"])}
