"""Rule-based extraction: from chunks (work_id, chunk_id, source_type, seq, text) to raw entities, without a shuffle.

Each function is one select over arrays of a chunk's own text; caps hold for one chunk. ``seq`` of a row is the chunk's
seq times 1000 plus the row's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T

#: Words and patterns of the extraction rules.
NAME_STOP = ["그리고", "하지만", "그때", "여기", "저기", "오늘", "내일", "어제", "학생", "교수", "기차", "학교", "장", "번", "이상", "정도", "순간", "다음", "아침", "저녁", "사람", "아이", "남자", "여자", "부부"]
SPEAKER = r"(?m)^\s*([가-힣A-Za-z0-9_ ]{1,30})\s*:\s*"
SAID = r"([가-힣A-Za-z]{2,12})(?:은|는|이|가)\s*(?:말했|물었|소리쳤|외쳤|대답했|중얼거렸|생각했|바라보았|바라봤)"
SAYING = "말했|물었|소리쳤|외쳤|대답했|중얼거렸|생각했|바라보았|바라봤"
TOGETHER = r"([가-힣A-Za-z]{2,12})와\s*([가-힣A-Za-z]{2,12})"
HEADER = r"===(.+?)==="
NUMBERED = r"(?m)^\d+\.\s+([가-힣]{2,5})\s*[(（]"
FACT_WORDS = "이다|였다|있다|없다|했다|된다|보였다|말했다|물었다"
TRAIT_KEYS = ["혈액형", "식습관", "성격", "목표", "능력", "특기", "직업", "직위", "나이", "키", "출신", "배경", "직급"]
TRAIT_WORDS = [("커피", "커피"), ("결벽", "결벽증"), ("채식", "식습관"), ("술", "음주"), ("혈액형", "혈액형")]
FEELINGS = [("신뢰", "trust"), ("trust", "trust"), ("증오", "hate"), ("미워", "hate"), ("hate", "hate"), ("사랑", "love"), ("love", "love"), ("두려움", "fear"), ("두려워", "fear"), ("무서워", "fear"), ("fear", "fear"), ("질투", "jealousy"), ("중립", "neutral"), ("neutral", "neutral"), ("감사", "gratitude"), ("분노", "hate"), ("경멸", "contempt"), ("불신", "distrust")]
FEELING_VERBS = [("증오", "hate"), ("미워", "hate"), ("사랑", "love"), ("좋아", "love"), ("신뢰", "trust"), ("믿어", "trust"), ("두려워", "fear"), ("무서워", "fear"), ("질투", "jealousy")]
RELATIONS = [("동료", "colleague"), ("파트너", "colleague"), ("친구", "ally"), ("적", "enemy"), ("형", "family_sibling"), ("언니", "family_sibling"), ("오빠", "family_sibling"), ("누나", "family_sibling"), ("아버지", "family_parent"), ("어머니", "family_parent"), ("부모", "family_parent"), ("자녀", "family_child"), ("부부", "family_spouse"), ("연인", "romantic")]
LEARNING = r"\(.*?(?:진술|증언|확인|검토|발견).*?\)|이제\s*(?:확실|알겠|알았|분명)|처음부터\s*알고|(?:그래서|그러니까|결국)\s*범인"
LEARN_VERBS = ["알았다", "알게됐다", "알게 됐다", "깨달았다", "확인했다", "발견했다", "들었다", "봤다", "알려줬다", "알게되었다", "파악했다", "인지했다"]
STAGE = ["무대", "지문", "해설", "자막", "나레이션"]
TRANSFERS = "건네|줬|주었|넘겨|양도|빼앗|가져"
USES = ["보여", "사용했", "들었", "꺼냈", "뽑았"]
THINGS = ["칼", "총", "가방", "서류", "증거", "열쇠", "폰", "핸드폰", "무기"]
DEAD = "사망|죽|dead|사체"


def _all(text, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text if isinstance(text, Column) else F.col(text), F.lit(pattern), group)


def _where(cond: Column, items: Column, kind: str) -> Column:
    """The array ``items`` of texts that pass ``cond``, which holds wherever it has a member; none, and no further search, elsewhere."""
    return F.when(cond, items).otherwise(F.array().cast(f"array<{kind}>"))


def _holds(text: Column, words: Column) -> Column:
    """Those of the words that are in the text."""
    return F.filter(words, lambda w: F.contains(text, w))


def _header_name(header: Column) -> Column:
    """A single capital of a header, else its first two to four Korean letters; null without either."""
    letter = F.regexp_extract(header, r"\b([A-Z])\b", 1)
    return F.nullif(F.when(letter != "", letter).otherwise(F.regexp_extract(header, "([가-힣]{2,4})", 1)), F.lit(""))


def character_names(c: DataFrame) -> Column:
    """A chunk's character names: of speakers, of narrated speech, of pairs (eight at most), then of headers."""
    text = F.col("text")
    pairs = F.flatten(F.zip_with(_all(text, TOGETHER, 1), _all(text, TOGETHER, 2), lambda a, b: F.array(a, b)))
    pairs, said = _where(F.contains(text, F.lit("와")), pairs, "string"), _where(F.rlike(text, F.lit(SAYING)), _all(text, SAID), "string")
    raw = F.transform(F.concat(_all(text, SPEAKER), said, pairs), T.strip)
    good = lambda n: (n != "") & ~n.isin(NAME_STOP) & ~F.rlike(n, F.lit(r"^\p{Nd}+$")) & (F.length(n) <= 20) & ((F.length(n) > 1) | F.rlike(n, F.lit(r"^\p{Lu}$")))
    told = F.slice(F.array_distinct(F.filter(raw, good)), 1, 8)
    heads = F.filter(F.concat(F.transform(_all(text, HEADER), lambda h: _header_name(T.strip(h))), _all(text, NUMBERED)), lambda n: n.isNotNull())
    return F.when(F.col("source_type").isin("settings", "scenario"), F.array_distinct(F.concat(told, heads))).otherwise(told)


def _rows(c: DataFrame, items: Column, most: int | None = None) -> DataFrame:
    """A row for each struct of the array, with its fields as columns."""
    items = F.slice(items, 1, most) if most else items
    out = c.select("work_id", "chunk_id", "source_type", (F.col("seq") * 1000).alias("_base"), F.posexplode(items).alias("_pos", "_x"))
    return out.select("work_id", F.col("chunk_id").alias("source_chunk_id"), "source_type", (F.col("_base") + F.col("_pos")).alias("seq"), "_x.*")


def characters(c: DataFrame) -> DataFrame:
    """Name, possible_aliases (none)."""
    return _rows(c, F.transform(character_names(c), lambda n: F.struct(n.alias("name"), F.array().cast("array<string>").alias("possible_aliases"))))


def _sentences() -> Column:
    return F.filter(F.transform(F.split("text", r"[.!?\n]+"), T.strip), lambda s: F.length(s) >= 12)


def facts(c: DataFrame) -> DataFrame:
    """Content and category of those of the first three sentences that state something, else of the first."""
    s = _sentences()
    stated = F.filter(F.slice(s, 1, 3), lambda x: F.rlike(x, F.lit(FACT_WORDS)))
    picked = F.when(F.size(stated) > 0, stated).otherwise(F.slice(s, 1, 1))
    kind = F.when(F.col("source_type") == "scenario", "event_fact").otherwise("world_fact")
    return _rows(c, F.transform(picked, lambda x: F.struct(F.substring(x, 1, 200).alias("content"), kind.alias("category_hint"), F.lit(False).alias("is_secret_hint"))))


def _lines_with_header(c: DataFrame) -> Column:
    """The lines of a chunk as structs (line, who): who is the character of the header above; header lines have none."""
    lines = F.split("text", "\n")
    named = F.transform(lines, lambda x: F.struct(x.alias("line"), F.rlike(x, F.lit(HEADER)).alias("h"), F.rlike(x, F.lit(NUMBERED)).alias("n"), F.when(F.rlike(x, F.lit(HEADER)), _header_name(T.strip(F.regexp_extract(x, HEADER, 1)))).otherwise(F.nullif(F.regexp_extract(x, NUMBERED, 1), F.lit(""))).alias("name")))
    # the nearest header at or before a line
    place = F.transform(named, lambda x, i: F.when(x["h"] | x["n"], i).otherwise(F.lit(-1)))
    last = F.transform(place, lambda p, i: F.array_max(F.slice(place, F.lit(1), i + 1)))
    under = F.filter(F.zip_with(named, last, lambda x, k: F.struct(x["line"].alias("line"), (x["h"] | x["n"]).alias("head"), F.when(k >= 0, F.element_at(named, k + 1)["name"]).alias("who"))), lambda x: ~x["head"] & x["who"].isNotNull())
    return _where(F.rlike("text", F.lit(HEADER)) | F.rlike("text", F.lit(NUMBERED)), under, "struct<line:string,head:boolean,who:string>")


def _lookup(text: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    out = F.when(F.lit(False), "")
    for word, value in pairs:
        out = out.when(F.contains(text, F.lit(word)), value)
    return out.otherwise(default)


def traits(c: DataFrame) -> DataFrame:
    """character_name, key, value, category_hint from lines under a header; ten at most."""

    def of(x: Column) -> Column:
        line = x["line"]
        desc = F.regexp_extract(line, r"^[-\s]*특성\s*:\s*(.+)", 1)
        value = F.when(F.contains(desc, F.lit("혐오")), "혐오").when(F.contains(desc, F.lit("결벽")), "결벽증").otherwise(F.substring(desc, 1, 40))
        listed = [F.when((desc != "") & F.contains(desc, F.lit(w)), F.struct(x["who"].alias("character_name"), F.lit(k).alias("key"), value.alias("value"), F.lit("personality").alias("category_hint"))) for w, k in TRAIT_WORDS]
        keyed = F.when(F.lit(False), F.lit(None).cast("struct<character_name:string,key:string,value:string,category_hint:string>"))
        for k in TRAIT_KEYS:
            got = F.regexp_extract(line, rf"{k}\s*:\s*([가-힣A-Za-z0-9()\s]+)", 1)
            kind = "physical" if k in ("혈액형", "키", "나이") else "personality"
            keyed = keyed.when(got != "", F.struct(x["who"].alias("character_name"), F.lit(k).alias("key"), F.substring(T.strip(got), 1, 50).alias("value"), F.lit(kind).alias("category_hint")))
        return F.filter(F.array(*listed, keyed), lambda y: y.isNotNull())

    return _rows(c.where(F.col("source_type").isin("settings", "scenario", "worldview")), F.flatten(F.transform(_lines_with_header(c), of)), 10)


def emotions(c: DataFrame) -> DataFrame:
    """from_char, to_char, emotion: of ``X에 대해: word`` under a header, then of speech that names another; eight at most."""

    def about(x: Column) -> Column:
        to, word = (F.regexp_extract(x["line"], r"([가-힣A-Za-z]{1,10})에 대해\s*:\s*([가-힣A-Za-z()]+)", k) for k in (1, 2))
        return F.when(to != "", F.struct(x["who"].alias("from_char"), T.strip(to).alias("to_char"), _lookup(word, FEELINGS, "neutral").alias("emotion")))

    named = F.filter(F.transform(_lines_with_header(c), about), lambda x: x.isNotNull())
    c = c.withColumn("_names", F.slice(character_names(c), 1, 5))
    quoted = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    c = c.withColumn("_verbs", F.filter(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(e).alias("e")) for w, e in FEELING_VERBS)), lambda v: F.contains(F.col("text"), v["w"])))
    spoken = F.flatten(F.flatten(F.transform("_names", lambda a: F.transform("_names", lambda b: F.transform(F.filter("_verbs", lambda v: (a != b) & F.rlike(F.col("text"), F.concat(F.lit(r"(?m)^\s*"), quoted(a), F.lit(r"\s*:.*"), quoted(b), F.lit(".*"), v["w"]))), lambda v: F.struct(a.alias("from_char"), b.alias("to_char"), v["e"].alias("emotion")))))))
    return _rows(c, F.concat(F.when(F.col("source_type").isin("settings", "scenario", "worldview"), named).otherwise(F.slice(named, 1, 0)), spoken), 8)


def relationships(c: DataFrame) -> DataFrame:
    """E5: char_a, char_b, type_hint, detail of arrows and of ``A와 B는 word``, distinct by pair and type, the first stays; eight at most."""
    arrow = r"([가-힣A-Za-z]{1,10})\s*[↔←→]\s*([가-힣A-Za-z]{1,10})\s*:\s*([가-힣A-Za-z()\s]+)"
    a, b, rel = (_all("text", arrow, k) for k in (1, 2, 3))
    arrows = F.transform(F.arrays_zip(a, b, rel), lambda x: F.struct(T.strip(x["0"]).alias("char_a"), T.strip(x["1"]).alias("char_b"), _lookup(x["2"], RELATIONS, "colleague").alias("type_hint"), F.substring(T.strip(x["2"]), 1, 50).alias("detail")))
    told = []
    for word, kind in RELATIONS:
        p = rf"([가-힣A-Za-z]{{1,10}})와\s+([가-힣A-Za-z]{{1,10}})(?:는|이|가|은)\s+{word}"
        both = F.contains("text", F.lit("와")) & F.contains("text", F.lit(word))
        told.append(_where(both, F.zip_with(_all("text", p, 1), _all("text", p, 2), _told(kind, word)), RELATED))
    each = F.concat(_where(F.rlike("text", F.lit("[↔←→]")), arrows, RELATED), *told)
    key = lambda x: F.struct(x["char_a"], x["char_b"], x["type_hint"])
    first = F.filter(each, lambda x, i: ~F.exists(F.slice(each, F.lit(1), i), lambda y: key(y) == key(x)))
    return _rows(c, first, 8)


def _told(kind: str, word: str):
    return lambda x, y: F.struct(x.alias("char_a"), y.alias("char_b"), F.lit(kind).alias("type_hint"), F.lit(word).alias("detail"))


RELATED = "struct<char_a:string,char_b:string,type_hint:string,detail:string>"
KNOWS = "struct<character_name:string,fact_content:string,event_type:string,method:string,dialogue_text:string>"


def knowledge_events(c: DataFrame) -> DataFrame:
    """Who mentions or learns what, from speech and then from narration; sixteen at most, of scenario and settings.

    Speech is learning if the stage direction before it, one inside it or its own words say so; an opening sentence that
    only says so is left out of the fact.
    """
    speech = r"(?s)^\s*([가-힣A-Za-z]{1,20})\s*:\s*(.{5,200})"
    lines = F.split("text", "\n")

    def read(x: Column) -> Column:
        s = T.strip(x)
        alone = s.startswith("[") | (s.startswith("(") & ~F.rlike(x, F.lit(r"^\s*[가-힣A-Za-z]{1,20}\s*:")))
        who, said = (F.when(~alone, F.regexp_extract(x, speech, k)).otherwise("") for k in (1, 2))
        return F.struct((alone & F.rlike(s, F.lit(LEARNING))).alias("sets"), who.alias("who"), T.strip(said).alias("said"))

    parsed = F.transform(lines, read)

    def event(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(parsed, F.greatest(i, F.lit(1)))["sets"]).otherwise(False)
        direction, rest = (F.regexp_extract(x["said"], r"(?s)^(\([^)]{1,50}\))\s*(.*)", k) for k in (1, 2))
        content = F.when(direction != "", T.strip(rest)).otherwise(x["said"])
        learns = before | F.rlike(direction, F.lit(LEARNING)) | F.rlike(content, F.lit(LEARNING))
        parts = F.split(content, r"(?<=[.?!])\s+")
        later = T.strip(F.array_join(F.slice(parts, 2, 1000), " "))
        bare = F.when(learns & (F.size(parts) > 1) & F.rlike(F.element_at(parts, 1), F.lit(LEARNING)) & (F.length(later) >= 5), later).otherwise(content)
        ok = (x["who"] != "") & ~x["who"].isin(STAGE) & (F.length(content) >= 5)
        return F.when(ok, F.struct(x["who"].alias("character_name"), F.substring(bare, 1, 100).alias("fact_content"), F.when(learns, "learns").otherwise("mentions").alias("event_type"), F.when(learns, "testimony").otherwise("direct_speech").alias("method"), F.substring(x["said"], 1, 100).alias("dialogue_text")))

    spoken = F.filter(F.transform(parsed, event), lambda x: x.isNotNull())
    c = c.withColumn("_names", F.slice(character_names(c), 1, 5))
    c = c.withColumn("_verbs", _holds(F.col("text"), F.array(*map(F.lit, LEARN_VERBS))))
    pattern = lambda n, v: F.concat(F.lit(r"(\Q"), n, F.lit(r"\E(?:이|가)?\s*.{5,60}"), v, F.lit(")"))
    told = F.flatten(F.flatten(F.transform("_names", lambda n: F.transform("_verbs", lambda v: F.transform(F.regexp_extract_all(F.col("text"), pattern(n, v), F.lit(1)), lambda m: F.struct(n.alias("character_name"), F.substring(m, 1, 100).alias("fact_content"), F.lit("learns").alias("event_type"), F.lit("observation").alias("method"), F.lit(None).cast("string").alias("dialogue_text")))))))
    return _rows(c.where(F.col("source_type").isin("scenario", "settings")), F.concat(spoken.cast(f"array<{KNOWS}>"), told.cast(f"array<{KNOWS}>")), 16)


HAS = "struct<character_name:string,item_name:string,action:string,dead:boolean>"


def item_events(c: DataFrame) -> DataFrame:
    """character_name, item_name, action (possesses, loses, uses), and dead, in the order of rules; ten at most with the deaths.

    Rows with ``dead`` are deaths of their character and no possessions.
    """
    one = lambda who, item, action, dead=False: F.struct(who.alias("character_name"), F.substring(item, 1, 30).alias("item_name"), F.lit(action).alias("action"), F.lit(dead).alias("dead"))

    def listed(x: Column) -> Column:
        owns = F.regexp_extract(x["line"], r"소유물\s*:\s*([가-힣A-Za-z0-9()\s'\"]+)", 1)
        item = F.regexp_replace(T.strip(F.element_at(F.split(owns, r"[(\[,]"), 1)), "^['\"]+|['\"]+$", "")
        state = F.regexp_extract(x["line"], r"상태\s*:\s*(.+)", 1)
        return F.filter(F.array(F.when(owns != "", one(x["who"], item, "possesses")), F.when(F.rlike(state, F.lit(DEAD)), one(x["who"], F.lit(""), "possesses", True))), lambda y: y.isNotNull())

    under = F.flatten(F.transform(_lines_with_header(c), listed))
    p = r"([가-힣A-Za-z]{1,10})(?:이|가)\s+(.{1,20})(?:을|를)\s+([가-힣A-Za-z]{1,10})(?:에게|한테)\s*([가-힣A-Za-z]+)"
    given = F.filter(F.arrays_zip(*(_all("text", p, k) for k in (1, 2, 3, 4))), lambda x: F.rlike(x["3"], F.lit(TRANSFERS)))
    given = F.flatten(F.transform(given, lambda x: F.array(one(x["0"], T.strip(x["1"]), "loses"), one(x["2"], T.strip(x["1"]), "possesses"))))
    to_one = F.rlike("text", F.lit("에게|한테"))
    given = _where(to_one, given, HAS)
    q = r"(.{1,15})(?:을|를)\s+([가-힣A-Za-z]{1,10})(?:에게|한테)\s*(?:건네|주었|넘겨|양도)"
    got = F.zip_with(_all("text", q, 1), _all("text", q, 2), lambda item, who: one(who, T.strip(item), "possesses"))
    got = _where(to_one, got, HAS)
    c = c.withColumn("_names", F.slice(character_names(c), 1, 5))
    c = c.withColumn("_pairs", F.filter(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(u).alias("u")) for t in THINGS for u in USES)), lambda v: F.contains(F.col("text"), v["t"]) & F.contains(F.col("text"), v["u"])))
    used = F.flatten(F.transform("_names", lambda n: F.transform(F.filter("_pairs", lambda v: F.rlike(F.col("text"), F.concat(F.lit(r"\Q"), n, F.lit(r"\E.*?"), v["t"], F.lit(".*?"), v["u"]))), lambda v: one(n, v["t"], "uses"))))
    listing, scene = F.col("source_type").isin("settings", "scenario"), F.col("source_type") == "scenario"
    keep = lambda cond, a: F.when(cond, a).otherwise(F.slice(a, 1, 0))
    return _rows(c, F.concat(keep(listing, under), keep(scene, F.concat(given, got, used))), 10)


def events(c: DataFrame) -> DataFrame:
    """The first two sentences as events, and a death for each character whose state is dead."""
    said = _rows(c, F.transform(F.slice(_sentences(), 1, 2), lambda x: F.struct(F.substring(x, 1, 200).alias("description"), F.array().cast("array<string>").alias("characters_involved"), F.lit("scene").alias("event_type"), F.lit(None).cast("string").alias("status_char"), F.lit(None).cast("string").alias("location_hint"))))
    dead = item_events(c).where("dead").select("work_id", "source_chunk_id", "source_type", (F.col("seq") + 100).alias("seq"), F.concat("character_name", F.lit(" 사망")).alias("description"), F.array("character_name").alias("characters_involved"), F.lit("death").alias("event_type"), F.col("character_name").alias("status_char"), F.lit(None).cast("string").alias("location_hint"))
    return said.unionByName(dead)


def extract(c: DataFrame) -> dict[str, DataFrame]:
    """All raw entities of the chunks by kind, and ``empty``: chunks without a sentence or name."""
    return {"characters": characters(c), "facts": facts(c), "events": events(c), "traits": traits(c), "relationships": relationships(c), "emotions": emotions(c), "knowledge": knowledge_events(c), "items": item_events(c).where("NOT dead").drop("dead"), "empty": c.where((F.size(_sentences()) == 0) & (F.size(character_names(c)) == 0)).select("work_id", "chunk_id")}
