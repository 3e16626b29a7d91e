"""Text functions as Column expressions. Letters and digits are Unicode classes, blanks all white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L

SPACE = r"[\s 　]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any kind around."""
    return F.regexp_replace(_col(c), rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(c) -> Column:
    """Trimmed, small letters, what is no word character a blank, single blanks."""
    words = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(words, rf"{SPACE}+", " "))


def _without_suffix(x: Column, suffixes: list[str]) -> Column:
    """x without the first suffix of the list that it ends with and that leaves two characters."""
    out = F.when(F.lit(False), x)
    for s in suffixes:
        out = out.when(x.endswith(s) & (F.length(x) > len(s) + 1), F.substring(x, F.lit(1), F.length(x) - len(s)))
    return out.otherwise(x)


def semantic_tokens(c, strip_negation: bool = False) -> Column:
    """The distinct content words: one Korean ending off, stop words out; with strip_negation negation words too."""
    words = normal_tokens(normalize_text(c))
    return without_negations(words) if strip_negation else words


def normal_tokens(normal) -> Column:
    """``semantic_tokens`` of a text that is normal already."""
    words = F.regexp_extract_all(_col(normal), F.lit("([가-힣A-Za-z0-9]+)"), 1)
    bare = F.transform(words, lambda x: _without_suffix(x, L.TOKEN_SUFFIXES))
    return F.array_distinct(F.filter(bare, lambda x: ~x.isin(L.SEMANTIC_STOP) & (x != "")))


def without_negations(tokens) -> Column:
    return F.filter(_col(tokens), lambda x: ~x.isin(L.NEGATIONS))


def contains_negation(c) -> Column:
    """Whether a word is a negation or begins like one."""
    return normal_negation(normalize_text(c))


def normal_negation(normal) -> Column:
    """``contains_negation`` of a text that is normal already."""
    begins = lambda x: F.rlike(x, F.lit("^(" + "|".join(L.NEGATION_PREFIXES) + ")"))
    return F.exists(F.split(_col(normal), " "), lambda x: x.isin(L.NEGATIONS) | begins(x))


def jaccard(a, b) -> Column:
    """Jaccard similarity of two arrays as sets, 0 where either is empty or null."""
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def polarity_conflict(a, b) -> Column:
    """One text is negated, the other not, and their other words are alike (0.60)."""
    return (contains_negation(a) != contains_negation(b)) & (jaccard(semantic_tokens(a, True), semantic_tokens(b, True)) >= 0.60)


def numeric_conflict(a, b) -> Column:
    """Both texts have numbers, not the same, and their other words are alike (0.60)."""
    numbers = [F.array_sort(F.array_distinct(F.regexp_extract_all(_col(x), F.lit(r"(\p{Nd}+)"), 1))) for x in (a, b)]
    words = [F.filter(semantic_tokens(x), lambda t: ~F.rlike(t, F.lit(r"\p{Nd}"))) for x in (a, b)]
    return (F.size(numbers[0]) > 0) & (F.size(numbers[1]) > 0) & (numbers[0] != numbers[1]) & (jaccard(*words) >= 0.60)


def fact_bigrams(c) -> Column:
    """Character pairs of a fact without marks and common Korean endings; of a shorter text the text itself."""
    t = F.regexp_replace(strip(c), "[.!?,。、·…]", " ")
    t = F.regexp_replace(t, "(?<=[가-힣])(이야|이다|이에요|이었|이고|이며|이랑|야|다|해요|했다|해|ㅎ)", " ")
    t = strip(F.regexp_replace(t, rf"{SPACE}+", " "))
    pairs = F.regexp_extract_all(t, F.lit("(?s)(?=(..))"), 1)
    return F.when(F.length(t) >= 2, F.array_distinct(pairs)).otherwise(F.array(t))


def fact_similarity(a, b) -> Column:
    return jaccard(fact_bigrams(a), fact_bigrams(b))


def subject_keywords(c) -> Column:
    """The first five distinct words of two characters or more, longest particle off, common words out."""
    words = F.regexp_extract_all(_col(c), F.lit("([가-힣A-Za-z0-9]+)"), 1)
    longest_first = sorted(L.PARTICLES, key=len, reverse=True)
    bare = F.transform(words, lambda x: _without_suffix(x, longest_first))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= 2) & ~x.isin(L.CONTENT_STOP))), 1, 5)


def is_prohibitive(c) -> Column:
    """Whether the text holds one of the words of prohibition or disgust."""
    return F.rlike(_col(c), F.lit("|".join(L.PROHIBITIVE)))


def _pairs(numbers: Column, units: Column, kind: Column | str) -> Column:
    """Structs (kind, value, unit) of parallel arrays."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.zip_with(numbers, units, lambda n, u: F.struct(kind.alias("kind"), n.cast("int").alias("value"), u.alias("unit")))


def fact_constraints(c) -> Column:
    """Numeric rules of a fact as structs (kind, value, unit): min_duration, min_duration_general, lockout_after_hour.

    Minutes of a clock time are no duration; they are masked before durations are looked for.
    """
    text = _col(c)
    masked = F.regexp_replace(text, r"(\p{Nd}+\s*시\s*)\p{Nd}+(\s*분)", "$1#$2")
    pattern = r"(?:최소|최단|적어도)\s*(\p{Nd}+)\s*(분|시간|초)(?:\s*(?:이상|소요|걸림|이내))?|(\p{Nd}+)\s*(분|시간|초)\s*(?:이상|소요|걸림|걸린다|이내)"
    got = [F.regexp_extract_all(masked, F.lit(pattern), k) for k in (1, 2, 3, 4)]
    pick = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(y))
    kind = F.when(F.rlike(text, F.lit(L.NON_MOVEMENT)) & ~F.rlike(text, F.lit(L.MOVEMENT)), "min_duration_general").otherwise("min_duration")
    lasting = _pairs(pick(got[0], got[2]), pick(got[1], got[3]), kind)
    hours = F.regexp_extract_all(text, F.lit(r"(\p{Nd}+)\s*시\s*(?:이후|부터)"), 1)
    locked = F.transform(hours, lambda n: F.struct(F.lit("lockout_after_hour").alias("kind"), n.cast("int").alias("value"), F.lit("시").alias("unit")))
    return F.concat(lasting, F.when(F.rlike(text, F.lit(L.LOCKOUT)), locked).otherwise(F.filter(locked, lambda x: F.lit(False))))


def event_values(c) -> Column:
    """Elapsed times and clock hours of an event as structs (kind, value, unit)."""
    text = _col(c)
    pattern = F.lit(r"(\p{Nd}+)\s*(분|시간|초)\s*(?:만에|후|내에|안에)")
    lasting = _pairs(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), "duration_taken")
    hours = F.regexp_extract_all(text, F.lit(r"(?:오전|오후|밤|새벽)?\s*(\p{Nd}+)\s*시(?:\s*(?:에|쯤|경|정각))?"), 1)
    return F.concat(lasting, F.transform(hours, lambda n: F.struct(F.lit("clock_time").alias("kind"), n.cast("int").alias("value"), F.lit("시").alias("unit"))))


#: What every text with a clock time holds.
HOUR = r"\p{Nd}\s*시"


def timestamp_minutes(c) -> Column:
    """The first clock time in minutes of the day, with words for morning and evening; null without one."""
    text, pattern = _col(c), r"(오전|오후|밤|새벽|낮|정오)?\s*(\p{Nd}{1,2})\s*시\s*(?:(\p{Nd}{1,2})\s*분)?"
    part, hour, minute = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    h = hour.cast("int")
    h = F.when(part.isin("오후", "밤") & (h < 12), h + 12).when((part == "새벽") & (h == 12), F.lit(0)).otherwise(h)
    return F.when(hour != "", h * 60 + F.when(minute != "", minute.cast("int")).otherwise(0))


def relationship_type(c) -> Column:
    """A relationship word as its type: a type as it is, else that of the first word contained, else the text; empty: colleague."""
    raw = _col(c)
    low = F.lower(strip(raw))
    out = F.when(F.coalesce(raw, F.lit("")) == "", "colleague").when(low.isin(L.RELATIONSHIP_TYPES), low)
    for word, kind in L.RELATIONSHIP_WORDS.items():
        out = out.when(F.contains(raw, F.lit(word)), kind)
    return out.otherwise(raw)


def report_keywords(c) -> Column:
    """Numbers with units of time, and Korean words of two characters or more without two common endings."""
    text = _col(c)
    words = F.regexp_extract_all(text, F.lit("([가-힣]+)"), 1)
    for ending in L.REPORT_ENDINGS:
        words = F.transform(words, _cut(ending))
    return F.array_distinct(F.concat(F.filter(words, lambda x: F.length(x) >= 2), F.regexp_extract_all(text, F.lit(r"(\p{Nd}+[분시간일월년])"), 1)))


def _cut(ending: str):
    return lambda x: F.regexp_replace(x, f"({ending})$", "")


def common_run(a, b, length: int = 20) -> Column:
    """Whether two texts share a run of that many characters."""
    runs = [F.regexp_extract_all(_col(x), F.lit(f"(?s)(?=(.{{{length}}}))"), 1) for x in (a, b)]
    return F.arrays_overlap(*runs)


def hangul_words(c) -> Column:
    """The distinct Korean words of two characters or more: the tokens of violation de-duplication."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit("([가-힣]{2,})"), 1)))


def chapter_marker(c) -> Column:
    """The first heading of a chapter or scene, by the patterns in their order; null without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(_col(c), f"(?i)({p})", 1), F.lit("")) for p in L.CHAPTER_PATTERNS))


def location_display(name, page, chapter, first, last) -> Column:
    """``name (Ch.x, p.y, La-b)`` with the parts there are."""
    inner = F.concat_ws(", ", F.concat(F.lit("Ch."), _col(chapter)), F.concat(F.lit("p."), _col(page).cast("string")), F.concat(F.lit("L"), _col(first).cast("string"), F.lit("-"), _col(last).cast("string")))
    return F.when(inner == "", _col(name)).otherwise(F.concat(_col(name), F.lit(" ("), inner, F.lit(")")))


def canonical_source(response, candidates) -> Column:
    """The source a reviewer chose: ``canonical:<id>``, or a response that is one of the candidates; null otherwise."""
    r = strip(response)
    named = F.trim(F.regexp_extract(r, r"(?i)canonical\s*:\s*(\S+)", 1))
    return F.when((named != "") & F.array_contains(_col(candidates), named), named).when(F.array_contains(_col(candidates), r), r)


def story_order_of(response) -> Column:
    """The number of ``story_order:<number>``, finite and not negative; null otherwise."""
    n = F.regexp_extract(_col(response), r"(?i)story_order\s*:\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(n != "", n.cast("double"))
