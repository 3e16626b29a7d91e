"""Secret scan with DataFrame functions alone: pattern rules, and character Markov models for what no rule names.

Two bigram models, of random strings and of ordinary identifiers, are trained from labelled samples: what the rules
catch in a bounded sample of documents, and the other words there. A long token that no rule has caught is reported
if the log-likelihood ratio of the two models is high enough. Scanning is one narrow pass over the whole texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, Java pattern, the group whose length counts, its least length. The bounds of access and hex stand
#: in the pattern, which gives the same matches as dropping shorter runs.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: A word that touches no place where a rule's value was taken out (a null character).
WORD = r"(?<![A-Za-z0-9+/_\x00-])[A-Za-z0-9+/_-]{6,}+(?!\x00)"
#: Symbols of the models: a-z, A-Z, digits and all else.
SYMBOLS = 63
SPAN = "array<struct<s:int,e:int,v:int>>"


def _spans(text: str, pattern: str, group: int = 0) -> Column:
    """The pattern's matches in a text column as (s, e, v): code point offsets and the length of a group.

    The text between matches is what a split by the same pattern gives, so offsets are running sums of lengths.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    m, v = f"regexp_extract_all({text}, '{p}', 0)", f"regexp_extract_all({text}, '{p}', {group})"
    return F.expr(
        f"""CASE WHEN {text} RLIKE '{p}' THEN aggregate(
            arrays_zip({m}, slice(split({text}, '{p}', -1), 1, size({m})), {v}),
            named_struct('at', 0, 'out', CAST(array() AS {SPAN})),
            (a, x) -> named_struct('at', a.at + length(x.`1`) + length(x.`0`), 'out', concat(a.out, array(named_struct('s', a.at + length(x.`1`), 'e', a.at + length(x.`1`) + length(x.`0`), 'v', length(x.`2`))))),
            a -> a.out) ELSE CAST(array() AS {SPAN}) END"""
    )


def _symbol(ch: str) -> str:
    """The number of a character's symbol."""
    return f"(CASE WHEN {ch} BETWEEN 'a' AND 'z' THEN ascii({ch}) - 97 WHEN {ch} BETWEEN 'A' AND 'Z' THEN ascii({ch}) - 39 WHEN {ch} BETWEEN '0' AND '9' THEN ascii({ch}) + 4 ELSE 62 END)"


def scan_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __text (null as empty) and a span array for each rule: assign, access, hex."""
    out = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    for kind, pattern, group, least in RULES:
        out = out.withColumn(kind, _spans("__text", pattern, group)).withColumn(kind, F.expr(f"filter({kind}, x -> x.v >= {least})"))
    return out


def train(docs: DataFrame, sample_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.5) -> list[float]:
    """Log-likelihood ratios of the SYMBOLS ** 2 bigrams, random against ordinary, by first and second symbol.

    The sample is the ``sample_docs`` documents whose keys have the smallest hashes, whole. Its positives are the
    values that the rules catch there, its negatives the words of six characters or more in what is left without them. With
    no sample at all both models are flat and nothing is reported.
    """
    key = F.xxhash64(id_col)
    last = docs.select(key.alias("k")).orderBy("k").limit(sample_docs).agg(F.max("k")).first()[0]
    ruled = scan_rules(docs.where(key <= F.lit(last if last is not None else 0)).select(text_col), text_col)
    base = F.concat("assign", "access", "hex")
    caught = ruled.select(F.explode(base).alias("x"), "__text").select(F.lit(1).alias("random"), F.expr("substring(__text, x.e - x.v + 1, x.v)").alias("w"))
    rest = F.col("__text")
    for _, pattern, group, least in RULES:
        rest = F.regexp_replace(rest, F.lit(pattern.replace(".=-]+)", f".=-]{{{least},}})") if group else pattern), F.lit("\x00"))
    others = ruled.select(F.lit(0), F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))))
    words = caught.union(others)
    codes = words.withColumn("c", F.expr(f"transform(split(w, ''), ch -> {_symbol('ch')})")).where("size(c) > 1")
    counts = codes.select("random", F.explode(F.expr(f"zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (x, y) -> x * {SYMBOLS} + y)")).alias("g")).groupBy("random", "g").count()
    table = [[0] * SYMBOLS**2 for _ in range(2)]
    for r in counts.collect():  # at most 2 * SYMBOLS ** 2 rows
        table[r["random"]][r["g"]] += r["count"]
    chance = []
    for t in table:  # P(second | first), smoothed towards how often the second symbol comes at all
        seconds = [sum(t[k::SYMBOLS]) + alpha for k in range(SYMBOLS)]
        firsts = [sum(t[k * SYMBOLS : (k + 1) * SYMBOLS]) for k in range(SYMBOLS)]
        chance.append([(t[g] + 5 * seconds[g % SYMBOLS] / sum(seconds)) / (firsts[g // SYMBOLS] + 5) for g in range(SYMBOLS**2)])
    return [round(math.log(y / x), 4) for x, y in zip(*chance)]


def scan(docs: DataFrame, ratios: list[float], least: float = 12.0, text_col: str = "text") -> DataFrame:
    """``docs`` with assign, access, hex and markov: the span arrays of the rules and of the models.

    A markov span is a run of 20 or more token characters that meets no rule's span and whose log-likelihood ratio
    is ``least`` or more. A null or empty text has no spans; repeated rows and null keys stay; columns of these names
    in ``docs`` are replaced. Time for one text grows with the square of its matches, with a small constant.
    """
    llr = F.lit(ratios)
    out = scan_rules(docs.drop("assign", "access", "hex", "markov"), text_col)
    base = F.concat("assign", "access", "hex")
    out = out.withColumn("__long", F.filter(_spans("__text", LONG), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    coded = F.expr(f"transform(__long, x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'c', transform(split(substring(__text, x.s + 1, x.e - x.s), ''), ch -> {_symbol('ch')})))")
    ratio = lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x["c"]) - 1), F.lit(0.0), lambda a, i: a + F.element_at(llr, F.element_at(x["c"], i) * SYMBOLS + F.element_at(x["c"], i + 1) + 1))
    markov = F.when(F.size("__long") > 0, F.transform(F.filter(coded, lambda x: ratio(x) >= least), lambda x: F.struct(x["s"], x["e"], x["v"]))).otherwise(F.expr(f"CAST(array() AS {SPAN})"))
    return out.withColumn("markov", markov).drop("__long", "__text")


def joined(kinds: list[str]) -> Column:
    """kind:start:end of the span columns, by start, then kind in the order given, comma-joined."""
    each = [F.expr(f"transform({k}, x -> named_struct('s', x.s, 'rank', {i}, 'e', x.e, 'kind', '{k}'))") for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
