"""Scoring against gold annotations, and cost."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.operators.holding import holding, meeting, names_in
from storyloom.plans.numbering import numbered
from storyloom.plans.stored import stored


def match_scores(violations: DataFrame, gold: DataFrame, least: float = 0.0) -> DataFrame:
    """Case, gold id and violation id with the share of the gold's keywords in the violation's text, where it is above 0
    and ``least`` or more.

    violations: case, vid, seq, text, is_hard; gold: case, gid, seq, keywords, category, hard_soft. Slices of a case's texts meet its
    golds; a keyword counts as often as the gold has it, and keywords that are empty or blank count as not found.
    """

    def enough(held: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # keywords left out count as not found, so these bounds let pass all that reach ``least`` of all
        hits = [held[rows].sum(axis=0) for rows in sets]
        near = [np.flatnonzero(h >= max(1.0, least * len(rows) - 1e-9)) for h, rows in zip(hits, sets)]
        k = np.repeat(np.arange(len(sets)), [len(x) for x in near])
        return k, np.concatenate(near), np.concatenate([h[x] for h, x in zip(hits, near)]), np.zeros(len(k), dtype=np.int64)

    own = ["case", "gid", "gseq", "category", "hard_soft"]
    asked = gold.withColumnRenamed("seq", "gseq").select(*own, F.size("keywords").alias("all"), F.col("keywords").alias("words"))
    hits = meeting(violations.select("case", "vid", "seq", "text", "is_hard"), asked, enough).withColumn("score", F.col("score") / F.col("all"))
    return hits.where(F.col("score") >= least).select(*own, "vid", "seq", "is_hard", "score")


def assign(violations: DataFrame, gold: DataFrame, least: float = 0.3) -> DataFrame:
    """Each gold in order takes its best free violation of ``least`` or more, the first on ties: case, gid, category, hard_soft, vid (null: missed), is_hard, score.

    In rounds every gold proposes to the best violation left to it, and a violation keeps the first gold of all that
    propose; what is refused falls away for good, with all pairs of later golds with a violation that is kept. That gives what
    one gold after the other would choose, and no task holds a case. Rounds end when no two golds propose to one violation.
    """
    scored = numbered(match_scores(violations, gold, least), ["case", "gseq", "gid", F.desc("score"), "seq", "vid"], name="place")
    first = scored.groupBy("case", "gid", "gseq").agg(F.min("place").alias("g"))
    left = stored(scored.join(first, ["case", "gid", "gseq"]))
    while True:
        best = stored(left.groupBy("g").agg(F.min("place").alias("place")).join(left, ["g", "place"]))
        kept = stored(best.groupBy("case", "vid").agg(F.min("g").alias("holder"), F.count("*").alias("k")))
        if kept.where("k > 1").isEmpty():
            break
        left = stored(left.join(kept.select("case", "vid", "holder"), ["case", "vid"], "left").where("holder IS NULL OR g <= holder").drop("holder"))
    return gold.select("case", "gid", "category", "hard_soft").join(best.select("case", "gid", "vid", "is_hard", "score"), ["case", "gid"], "left")


def counts(assigned: DataFrame, violations: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case tp, fp, fn and the hard and soft matches. cases: case, set."""
    a = assigned.groupBy("case").agg(
        F.count("vid").alias("tp"),
        F.count_if(F.col("vid").isNull()).alias("fn"),
        F.count_if(F.col("vid").isNotNull() & (F.col("hard_soft") == "hard")).alias("hard_total"),
        F.count_if((F.col("hard_soft") == "hard") & F.col("is_hard")).alias("hard_correct"),
        F.count_if(F.col("vid").isNotNull() & (F.col("hard_soft") != "hard")).alias("soft_total"),
        F.count_if((F.col("hard_soft") != "hard") & ~F.col("is_hard")).alias("soft_correct"),
    )
    v = violations.groupBy("case").agg(F.count("*").alias("found"))
    out = cases.join(a, "case", "left").join(v, "case", "left").fillna(0)
    return out.withColumn("fp", F.col("found") - F.col("tp")).drop("found")


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(df: DataFrame) -> DataFrame:
    """Df (tp, fp, fn) with precision, recall and f1."""
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_set(counted: DataFrame) -> DataFrame:
    """Micro-averages of each set and of all (set null)."""
    return scores(counted.rollup("set").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def recall_by_category(assigned: DataFrame) -> DataFrame:
    """The recall of each category (which reports call its F1)."""
    return assigned.groupBy("category").agg(F.count("vid").alias("tp"), F.count("*").alias("gold")).withColumn("recall", ratio("tp", "gold"))


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Least, mean and greatest precision, recall and f1 of repeated runs by set. runs: set, run, precision, recall, f1."""
    return runs.groupBy("set").agg(*(f(c).alias(f"{n}_{c}") for c in ("precision", "recall", "f1") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))))


def gold_statistics(gold: DataFrame) -> DataFrame:
    """Numbers of contradictions by category, by hard and soft, by set, and of all; gold: set, case, category, hard_soft."""
    g = gold.groupingSets([["category"], ["hard_soft"], ["set"], []], "category", "hard_soft", "set").agg(F.count("*").alias("n"), F.countDistinct("case").alias("cases"), F.count_if(F.col("hard_soft") == "hard").alias("hard"))
    return g.withColumn("soft", F.col("n") - F.col("hard"))


def expected_and_detected(results: DataFrame) -> DataFrame:
    """Expected, detected and difference for each case, subtotal of each group (case null) and in all; rows with an error are left out."""
    r = results.where("error IS NULL").rollup("group", "case").agg(F.sum("expected").alias("expected"), F.sum("total").alias("detected"))
    return r.withColumn("diff", F.col("detected") - F.col("expected"))


def resolved_names(results: DataFrame, names: DataFrame) -> DataFrame:
    """X11: results with the gold's name of their case, by a map (name, gold_name) or else as it is."""
    return results.join(names, "name", "left").withColumn("case", F.coalesce("gold_name", "name")).drop("gold_name")


def unmatched(results: DataFrame, gold: DataFrame) -> DataFrame:
    """X11: results without gold."""
    return results.join(gold.select("case").distinct(), "case", "left_anti")


#: Dollars for a million prompt and completion tokens, by model; others cost the default.
PRICES = {"small": (0.15, 0.60), "large": (2.50, 10.00)}
DEFAULT_PRICE = (1.00, 3.00)


def token_cost(usage: DataFrame, prices: dict[str, tuple[float, float]] = PRICES, default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """Tokens and cost by model and in all (model null), rounded to six places. usage: model, prompt_tokens, completion_tokens."""
    price = [F.coalesce(F.element_at(F.create_map(*(F.lit(x) for m, p in prices.items() for x in (m, p[k]))), F.col("model")), F.lit(default[k])) for k in (0, 1)]
    cost = F.col("prompt_tokens") * price[0] / 1_000_000 + F.col("completion_tokens") * price[1] / 1_000_000
    out = usage.withColumn("cost", cost).rollup("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    return out


def extraction_metrics(characters: DataFrame, facts: DataFrame, gold_characters: DataFrame, gold_facts: DataFrame, relations: DataFrame | None = None, gold_relations: DataFrame | None = None) -> DataFrame:
    """For each case, characters' precision, recall and F1 by name or alias, and the recall of facts: half of a gold
    fact's first five words of two characters or more, rounded down but one at least, are in one fact. With relations also their recall (``relation_recall``). characters: case, name, aliases; facts: case, content; gold: case, name / case, content."""
    names = characters.select("case", "name", F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("all"))
    spelt = names.select("case", "name", F.explode("all").alias("spelt"))
    hit = gold_characters.select("case", F.col("name").alias("spelt")).join(spelt, ["case", "spelt"]).withColumnRenamed("spelt", "gold")
    n = names.groupBy("case").agg(F.count("*").alias("found")).join(gold_characters.groupBy("case").agg(F.count("*").alias("gold")), "case", "full_outer").join(hit.groupBy("case").agg(F.countDistinct("gold").alias("matched"), F.countDistinct("name").alias("right")), "case", "left").fillna(0)
    words = F.slice(F.filter(F.split("content", r"\s+"), lambda w: F.length(w) >= 2), 1, 5)
    five = gold_facts.select("case", F.col("content").alias("gold"), words.alias("words"))
    asked = five.distinct().select("case", "gold", F.greatest(F.lit(1), F.floor(F.size("words") / 2)).alias("need"), F.explode("words").alias("name"))
    told = facts.select(F.col("case").alias("work_id"), F.xxhash64("content").alias("id"), F.col("content").alias("text")).distinct()
    held = names_in(told, asked.select(F.col("case").alias("work_id"), "name")).withColumnRenamed("work_id", "case")
    known = asked.join(held, ["case", "name"]).groupBy("case", "gold", "id").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need").select("case", "gold").distinct()
    right = five.join(known, ["case", "gold"], "left_semi").groupBy("case").agg(F.count("*").alias("known"))
    recall = five.groupBy("case").agg(F.count("*").alias("facts")).join(right, "case", "left").fillna(0).select("case", ratio("known", "facts").alias("fact_recall"))
    out = n.withColumns({"precision": ratio("right", "found"), "recall": ratio("matched", "gold")}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scored = out.select("case", "precision", "recall", "f1").join(recall, "case", "full_outer")
    return scored if relations is None else scored.join(relation_recall(relations, gold_relations), "case", "full_outer")


def relation_recall(relations: DataFrame, gold: DataFrame) -> DataFrame:
    """Case, relation_recall: the share of gold relations (case, char_a, char_b) of which both names hold, or are held
    in, the names of one extracted relation (case, char_a, char_b), in this order.

    Names are matched once for each distinct pair of them, so relations meet only where their first names do.
    """
    g = gold.select("case", F.monotonically_increasing_id().alias("gid"), F.col("char_a").alias("ga"), F.col("char_b").alias("gb"))
    e = relations.select("case", F.col("char_a").alias("ea"), F.col("char_b").alias("eb")).distinct()
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    firsts = g.select("case", "ga").distinct().join(e.select("case", "ea").distinct(), "case").where(within(F.col("ga"), F.col("ea")))
    known = g.join(firsts, ["case", "ga"]).join(e, ["case", "ea"]).where(within(F.col("gb"), F.col("eb"))).select("case", "gid").distinct()
    n = g.groupBy("case").agg(F.count("*").alias("gold")).join(known.groupBy("case").agg(F.count("*").alias("matched")), "case", "left").fillna(0)
    return n.select("case", ratio("matched", "gold").alias("relation_recall"))


def gold_annotations(expected: DataFrame) -> DataFrame:
    """Expectations (case, idx, description) as gold rows: gid, category by the first pattern group that is found, hard_soft by
    pattern, up to eight keywords (of quotations, numbers with units, known words) and up to four names."""
    text = F.col("description")
    kind = F.when(F.lit(False), "")
    for category, patterns in L.GOLD_CATEGORIES:
        kind = kind.when(F.rlike(text, F.lit("|".join(patterns))), category)
    quoted = F.regexp_extract_all(text, F.lit('["\u201c\u201d]([^"\u201c\u201d]+)["\u201c\u201d]'), 1)
    spoken = F.flatten(F.transform(quoted, lambda q: F.slice(F.filter(F.split(q, r"\s+"), lambda w: F.length(w) >= 2), 1, 3)))
    numbers = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(rf"(\p{{Nd}}+{u})"), 1) for u in L.GOLD_UNITS)))
    known = F.filter(F.array(*map(F.lit, L.GOLD_WORDS)), lambda w: F.contains(text, w))
    names = F.filter(F.regexp_extract_all(text, F.lit("([가-힣]{2,3})(?:이|가|은|는|의|를|에게|와|과|한테)"), 1), lambda n: ~n.isin(L.GOLD_STOP_NAMES))
    return expected.select(
        "case", F.concat_ws("-", "case", F.col("idx").cast("string")).alias("gid"), kind.otherwise(L.GOLD_DEFAULT).alias("category"), F.when(F.rlike(text, F.lit("|".join(L.GOLD_HARD))), "hard").otherwise("soft").alias("hard_soft"),
        "description", F.slice(F.array_distinct(names), 1, 4).alias("characters"), F.slice(F.array_distinct(F.concat(spoken, numbers, known)), 1, 8).alias("keywords"),
    )
