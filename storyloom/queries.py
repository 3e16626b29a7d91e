"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.operators import rules
from storyloom.plans import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EVENTS = """e AS (SELECT event_id AS seq, CAST(user_id % 8 AS VARCHAR) AS work_id, CAST(user_id AS VARCHAR) AS from_id, json_extract_string(props, '$.k') AS to_id,
    event_type, value, CAST(event_id AS DOUBLE) AS so, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS day FROM events),
  learns AS (SELECT *, seq % 3 <> 0 AS believed, 'U' || to_id AS via FROM e WHERE event_type = 'signup'), mentions AS (SELECT * FROM e WHERE event_type = 'view'),
  people AS (SELECT DISTINCT work_id, from_id AS id, 'U' || from_id AS name FROM e),
  deaths AS (SELECT work_id, from_id, arg_max(so, seq) AS died FROM e WHERE event_type = 'error' AND value > 40 GROUP BY 1, 2),
  false_facts AS (SELECT DISTINCT work_id, to_id, 'fact ' || to_id AS content FROM e WHERE CAST(to_id AS BIGINT) % 5 = 0)"""
REPORT = ["work_id", "type", "severity", "description", "confidence", "character_id", "needs_user_input", "is_hard", "seq"]


def report(df: DataFrame) -> DataFrame:
    return df.select(REPORT)


def _report_sql(kind: str, severity: str, description: str, confidence: str, source: str, ask: str = "false", character: str = "from_id", seq: str = "seq", ctes: str = "") -> str:
    return f"""WITH {EVENTS}{ctes} SELECT work_id, '{kind}' AS type, {severity} AS severity, {description} AS description, CAST({confidence} AS DOUBLE) AS confidence,
  CAST({character} AS VARCHAR) AS character_id, {ask} AS needs_user_input, ({confidence}) >= 0.8 AND NOT ({ask}) AS is_hard, CAST({seq} AS BIGINT) AS seq FROM {source}"""


def _rule(name: str, rule, graph=bindings.event_graph, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: report(rule(graph(spark, sf_dir, **options)))


_rule("d01_mention_before_learning", rules.mention_before_learning)
ORACLE_SQL["d01_mention_before_learning"] = _report_sql("information_asymmetry", "'critical'", "'캐릭터 ''U' || from_id || '''이(가) 사실을 알기 전(LEARNS story_order=' || learned || ') 이미 언급(MENTIONS story_order=' || so || ')'", "0.95",
    "mentions JOIN (SELECT work_id, from_id, to_id, min(so) AS learned FROM learns GROUP BY ALL) USING (work_id, from_id, to_id) WHERE so < learned")
_rule("d02_taught_by_ignorant", rules.taught_by_ignorant)
ORACLE_SQL["d02_taught_by_ignorant"] = _report_sql("information_asymmetry", "'critical'", "'''U' || from_id || '''이(가) ''U' || teacher || '''에게서 사실을 배우지만(story_order=' || so || '), ''U' || teacher || '''의 해당 사실 최초 인지는 더 늦음(story_order=' || teacher_at || ')'", "0.85", "bad",
    ctes=""", known AS (SELECT work_id, from_id AS teacher, to_id, min(so) AS teacher_at FROM (SELECT work_id, from_id, to_id, so FROM learns UNION ALL SELECT work_id, from_id, to_id, so FROM mentions) GROUP BY ALL),
  bad AS (SELECT l.*, k.teacher, k.teacher_at FROM learns l JOIN people p ON p.work_id = l.work_id AND p.name = l.via AND p.id <> l.from_id JOIN known k ON k.work_id = l.work_id AND k.teacher = p.id AND k.to_id = l.to_id
    WHERE k.teacher_at > l.so QUALIFY row_number() OVER (PARTITION BY l.work_id, l.from_id, k.teacher, l.to_id ORDER BY l.seq) = 1)""")  # fmt: skip
LATE = """, seen AS (SELECT work_id, from_id, day AS so, 0 AS rank, seq FROM e WHERE event_type = 'click' UNION ALL SELECT work_id, from_id, so, 1, seq FROM mentions UNION ALL SELECT work_id, from_id, so, 2, seq FROM learns),
  late AS (SELECT s.*, died FROM seen s JOIN deaths USING (work_id, from_id) WHERE so > died QUALIFY row_number() OVER (PARTITION BY work_id, from_id ORDER BY rank, seq) = 1)"""
_rule("d03_appears_after_death", rules.appears_after_death)
ORACLE_SQL["d03_appears_after_death"] = _report_sql("timeline", "'critical'", "'캐릭터 ''U' || from_id || '''이(가) 사망(story_order=' || died || ') 후 재등장(story_order=' || so || ')'", "0.95", "late", ctes=LATE)
ACTS = LATE + """, acts AS (SELECT e.*, died FROM e JOIN deaths USING (work_id, from_id) WHERE event_type IN ('click', 'view') AND so > died AND NOT EXISTS (SELECT 1 FROM late t WHERE t.work_id = e.work_id AND t.from_id = e.from_id)
    QUALIFY row_number() OVER (PARTITION BY work_id, from_id ORDER BY seq) = 1)"""
_rule("d04_acts_after_death", rules.acts_after_death)
ORACLE_SQL["d04_acts_after_death"] = _report_sql("timeline", "'critical'", "'캐릭터 ''U' || from_id || '''이(가) 사망(story_order=' || died || ') 후 이벤트에 등장(story_order=' || so || '): event ' || to_id", "0.95", "acts", ctes=ACTS)
_rule("d05_two_places", rules.two_places)
ORACLE_SQL["d05_two_places"] = _report_sql("timeline", "'critical'", "'캐릭터 ''U' || from_id || '''이(가) story_order=' || day || '에 동시에 ' || n || '개 장소 존재'", "0.98", "(SELECT work_id, from_id, day, count(*) AS n, min(seq) AS seq FROM e WHERE event_type = 'click' GROUP BY ALL HAVING count(DISTINCT to_id) > 1)")
_rule("d06_resurrections", rules.resurrections)
ORACLE_SQL["d06_resurrections"] = _report_sql("timeline", "'critical'", "'캐릭터 ''U' || from_id || '''이(가) 사망 후 재등장(story_order=' || so || '): event ' || to_id", "0.92", "risen",
    ctes=ACTS + """, told AS (SELECT work_id, from_id FROM late UNION SELECT work_id, from_id FROM acts),
  raised AS (SELECT e.*, died FROM e LEFT JOIN deaths USING (work_id, from_id) WHERE event_type IN ('click', 'view') AND seq % 97 = 0),
  risen AS (SELECT * FROM raised WHERE died IS NULL UNION ALL (SELECT r.* FROM raised r ANTI JOIN told USING (work_id, from_id) WHERE died IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r.work_id, r.from_id ORDER BY seq) = 1))""")  # fmt: skip
_conflicts = ", ".join(f"('{a}', '{b}', '{v}'), ('{b}', '{a}', '{v}')" for a, b, v in L.CONFLICTS)
_pick = lambda values: f"list_extract([{', '.join(repr(v) for v in values)}], CAST(seq % {len(values)} AS INT) + 1)"
_rule("d07_relationship_conflicts", rules.relationship_conflicts)
ORACLE_SQL["d07_relationship_conflicts"] = _report_sql("relationship", "CASE v WHEN 'critical' THEN 'critical' ELSE 'major' END", "'캐릭터 쌍의 관계 ' || CASE v WHEN 'critical' THEN '모순' ELSE '경고' END || ': ' || x || ' ↔ ' || y", "CASE v WHEN 'critical' THEN 0.95 ELSE 0.6 END", "bad", "v <> 'critical'", "NULL",
    ctes=f""", r AS (SELECT work_id, least(from_id, to_id) AS lo, greatest(from_id, to_id) AS hi, {_pick(L.RELATIONSHIP_TYPES)} AS kind, seq FROM e),
  m(x, y, v) AS (VALUES {_conflicts}), bad AS (SELECT a.work_id, a.seq, x, y, v FROM r a JOIN r b ON a.work_id = b.work_id AND a.lo = b.lo AND a.hi = b.hi AND a.seq < b.seq JOIN m ON m.x = a.kind AND m.y = b.kind)""")  # fmt: skip
_rule("d08_trait_conflicts", rules.trait_conflicts, bindings.trait_graph)
ORACLE_SQL["d08_trait_conflicts"] = """WITH b AS (SELECT p_brand, p_type, string_agg(CAST(p_size AS VARCHAR), ', ' ORDER BY p_partkey) AS vals, min(p_partkey) AS seq FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1)
  SELECT '0' AS work_id, 'trait' AS type, CASE WHEN p_type = 'ECONOMY' THEN 'critical' ELSE 'major' END AS severity, '캐릭터 ''' || p_brand || '''의 특성 ''' || p_type || ''': [' || vals || ']' AS description,
  CASE WHEN p_type = 'ECONOMY' THEN 0.95::DOUBLE ELSE 0.6::DOUBLE END AS confidence, p_brand AS character_id, p_type <> 'ECONOMY' AS needs_user_input, p_type = 'ECONOMY' AS is_hard, seq FROM b"""
_opposites = " OR ".join(f"(before = '{a}' AND emotion = '{b}') OR (before = '{b}' AND emotion = '{a}')" for a, b in L.OPPOSITE_EMOTIONS)
_rule("d09_emotion_flips", rules.emotion_flips)
ORACLE_SQL["d09_emotion_flips"] = _report_sql("emotion", "'major'", "'캐릭터 ''U' || from_id || '''의 감정이 트리거 없이 ' || before || ' → ' || emotion || ' 급변'", "0.6", f"f WHERE {_opposites}", "true",
    ctes=f""", f0 AS (SELECT *, {_pick(L.EMOTIONS)} AS emotion FROM e), f AS (SELECT *, lag(emotion) OVER (PARTITION BY work_id, from_id, to_id ORDER BY so, seq) AS before FROM f0)""")
_rule("d10_shared_items", rules.shared_items, by_day=True)
ORACLE_SQL["d10_shared_items"] = _report_sql("item", "'critical'", "'아이템 ''item ' || to_id || '''이 story_order=' || day || '에 ' || n || '명에게 동시 소유'", "0.95", "(SELECT work_id, to_id, day, count(*) AS n, min(seq) AS seq FROM e WHERE event_type = 'purchase' GROUP BY ALL HAVING count(DISTINCT from_id) > 1)", character="NULL")
_rule("d11_repossessions", rules.repossessions)
ORACLE_SQL["d11_repossessions"] = _report_sql("item", "'major'", "'캐릭터 ''U' || from_id || '''이(가) ''item ' || to_id || ''' 분실(story_order=' || lost || ') 후 재소유(story_order=' || so || ')'", "0.65", "h WHERE event_type = 'purchase' AND so > lost", "true",
    ctes=""", h AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN so END IGNORE NULLS) OVER (PARTITION BY work_id, to_id, from_id ORDER BY so, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lost FROM e WHERE event_type IN ('purchase', 'error'))""")
_rule("d12_unexplained_transfers", rules.unexplained_transfers)
ORACLE_SQL["d12_unexplained_transfers"] = _report_sql("item", "'critical'", "'유일 아이템 ''item ' || to_id || ''': ''U' || owner || '''이(가) 분실 기록 없이 ''U' || from_id || '''이(가) 소유(story_order=' || so || ')'", "0.85", "p WHERE owner <> from_id AND NOT EXISTS (SELECT 1 FROM e l WHERE l.event_type = 'error' AND l.work_id = p.work_id AND l.to_id = p.to_id AND l.from_id = p.owner)", "true", "NULL",
    ctes=""", p AS (SELECT *, lag(from_id) OVER (PARTITION BY work_id, to_id ORDER BY so, seq) AS owner FROM e WHERE event_type = 'purchase')""")
_rule("d13_lies_after_truth", rules.lies_after_truth)
ORACLE_SQL["d13_lies_after_truth"] = _report_sql("deception", "'critical'", "'캐릭터 ''U' || from_id || '''이(가) 진실 인지(story_order=' || truth || ') 후에도 거짓 사실을 언급(story_order=' || so || ')'", "0.9",
    "mentions JOIN (SELECT work_id, from_id, to_id, min(so) AS truth FROM learns JOIN false_facts USING (work_id, to_id) WHERE NOT believed GROUP BY ALL) USING (work_id, from_id, to_id) WHERE so > truth")
_rule("d14_believed_lies", rules.believed_lies)
ORACLE_SQL["d14_believed_lies"] = _report_sql("deception", "'minor'", "'캐릭터 ''U' || from_id || '''이(가) 거짓 사실을 진실로 학습(story_order=' || since || ')'", "0.55", "(SELECT work_id, from_id, to_id, arg_max(so, seq) AS since, min(seq) AS seq FROM learns JOIN false_facts USING (work_id, to_id) WHERE believed GROUP BY ALL)", "true")
_rule("d17_broken_numbers", rules.broken_numbers, bindings.number_graph)
ORACLE_SQL["d17_broken_numbers"] = """WITH kw AS (SELECT *, CAST(p_partkey % 500 AS VARCHAR) AS work_id, 'f' || p_partkey AS fact_id, [w FOR w IN regexp_extract_all('최소 ' || p_size || '분 소요 ' || p_name, '[가-힣A-Za-z0-9]+') IF length(w) >= 2 AND w NOT IN ('최소', '소요')] AS words FROM part),
  facts AS (SELECT *, list_slice([words[i] FOR i IN range(1, len(words) + 1) IF list_position(words, words[i]) = i], 1, 5) AS kws FROM kw),
  line AS (SELECT CAST(l_partkey % 500 AS VARCHAR) AS work_id, l_orderkey * 10 + l_linenumber AS seq, CAST(l_quantity AS INT) AS q, p_name || ' ' || CAST(l_quantity AS INT) || '분 만에 이동' AS txt FROM lineitem JOIN part ON l_partkey = p_partkey),
  hit AS (SELECT f.work_id, f.fact_id, f.p_size, l.seq, l.q, l.txt FROM facts f JOIN line l ON f.work_id = l.work_id AND l.q < f.p_size AND (len(f.kws) = 0 OR len([k FOR k IN f.kws IF contains(l.txt, k)]) > 0)
    QUALIFY row_number() OVER (PARTITION BY f.work_id, f.fact_id ORDER BY l.seq) = 1)
  SELECT work_id, 'timeline' AS type, 'critical' AS severity, '세계 규칙 위반 — 최소 ' || p_size || '분 소요 구간을 ' || q || '분 만에 이동(story_order=' || CAST(seq AS DOUBLE) || '): ' || substr(txt, 1, 80) AS description, 0.95::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS character_id, false AS needs_user_input, true AS is_hard, seq FROM hit"""

_rule("d15_broken_prohibitions", rules.broken_prohibitions, bindings.habit_graph)
ORACLE_SQL["d15_broken_prohibitions"] = _report_sql("trait", "CASE WHEN fixed THEN 'critical' ELSE 'major' END", "'캐릭터 ''U' || from_id || '''의 특성 ''k: ' || kw || ' 금지''을(를) 위반하는 행동 발생(story_order=' || so || '): ' || txt", "CASE WHEN fixed THEN 0.85 ELSE 0.7 END", "bad", "NOT fixed",
    ctes=""", bad AS (SELECT t.work_id, t.from_id, t.to_id AS kw, t.seq % 2 = 0 AS fixed, c.so, c.seq, 'event ' || c.to_id AS txt FROM learns t JOIN e c ON c.work_id = t.work_id AND c.from_id = t.from_id AND c.event_type IN ('click', 'view')
      AND length(t.to_id) >= 2 AND contains('event ' || c.to_id, t.to_id) QUALIFY row_number() OVER (PARTITION BY t.work_id, t.from_id, t.to_id ORDER BY c.seq, t.seq) = 1)""")  # fmt: skip
_rule("d18_broken_gaps", rules.broken_gaps, bindings.clock_graph)
ORACLE_SQL["d18_broken_gaps"] = """WITH told AS (SELECT p_partkey, p_size, p_name, '최소 ' || p_size || '분 소요' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_name END AS content FROM part),
  words AS (SELECT *, CAST(p_partkey % 50 AS VARCHAR) AS work_id, [w FOR w IN regexp_extract_all(content, '[가-힣A-Za-z0-9]+') IF length(w) >= 2 AND w NOT IN ('최소', '소요')] AS ws FROM told),
  facts AS (SELECT *, list_slice([ws[i] FOR i IN range(1, len(ws) + 1) IF list_position(ws, ws[i]) = i], 1, 5) AS kws FROM words),
  line AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS work_id, l_orderkey * 10 + l_linenumber AS seq, (CAST(l_quantity AS INT) % 24) * 60 + l_orderkey % 60 AS ts, p_name || ' ' || CAST(l_quantity AS INT) % 24 || '시 ' || l_orderkey % 60 || '분 도착' AS txt FROM lineitem JOIN part ON l_partkey = p_partkey),
  pairs AS (SELECT *, ts - lag(ts) OVER w AS gap, lag(txt) OVER w AS before FROM line WINDOW w AS (PARTITION BY work_id ORDER BY seq, txt)),
  hit AS (SELECT f.work_id, f.p_size, g.seq, g.gap, g.txt FROM facts f JOIN pairs g ON f.work_id = g.work_id AND g.gap > 0 AND g.gap < f.p_size AND (len(f.kws) <= 2 OR len([k FOR k IN f.kws IF contains(g.before || ' ' || g.txt, k)]) > 0)
    QUALIFY row_number() OVER (PARTITION BY f.work_id, f.p_partkey ORDER BY g.seq, g.txt) = 1)
  SELECT work_id, 'timeline' AS type, 'critical' AS severity, '세계 규칙 위반 — 최소 ' || p_size || '분 소요 구간을 ' || gap || '분 만에 이동(story_order=' || CAST(seq AS DOUBLE) || '): ' || substr(txt, 1, 60) AS description, 0.95::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS character_id, false AS needs_user_input, true AS is_hard, seq FROM hit"""


def active_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, probes = bindings.spans_and_probes(spark, sf_dir)
    return rules.active_at(spans, probes, width=16.0).groupBy("work_id", "from_id", "time").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


QUERIES["d07b_active_relationships"] = active_relationships
ORACLE_SQL["d07b_active_relationships"] = f"""WITH {EVENTS} SELECT work_id, from_id, p.so AS time, count(*) AS n, min(s.seq) AS first_seq, max(s.seq) AS last_seq FROM learns p JOIN e s USING (work_id, from_id)
  WHERE s.event_type <> 'signup' AND s.so <= p.so AND (s.seq % 4 = 0 OR p.so <= s.so + s.seq % 997) GROUP BY ALL"""


def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.consolidate import summary

    g = bindings.event_graph(spark, sf_dir)
    return summary(rules.mention_before_learning(g).unionByName(rules.relationship_conflicts(g)).unionByName(rules.emotion_flips(g)))


QUERIES["c13_violation_summary"] = violation_summary
_parts = [ORACLE_SQL[k] for k in ("d01_mention_before_learning", "d07_relationship_conflicts", "d09_emotion_flips")]
ORACLE_SQL["c13_violation_summary"] = f"""WITH v AS ({' UNION ALL '.join(f'SELECT * FROM ({p})' for p in _parts)}), h AS (SELECT *, CASE WHEN is_hard THEN 'hard' ELSE 'soft' END AS hard_soft FROM v)
  SELECT work_id, CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(type) = 0 THEN 'type' WHEN grouping(hard_soft) = 0 THEN 'hard_soft' ELSE 'all' END AS facet,
  coalesce(severity, type, hard_soft, 'all') AS value, count(*) AS total, count_if(needs_user_input) AS confirmations FROM h GROUP BY GROUPING SETS ((work_id, severity), (work_id, type), (work_id, hard_soft), (work_id))"""


def knowledge_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.graph_ops import knowledge_at as at

    probes = bindings.read(spark, sf_dir, "customer").select((F.col("c_custkey") % 8).cast("string").alias("work_id"), F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") * 40.0).alias("at"))
    return at(bindings.event_graph(spark, sf_dir), probes).select("work_id", "id", "at", "fact_id", "story_order")


QUERIES["q01_knowledge_at"] = knowledge_at
ORACLE_SQL["q01_knowledge_at"] = f"WITH {EVENTS} SELECT work_id, from_id AS id, c_custkey * 40.0::DOUBLE AS at, to_id AS fact_id, so AS story_order FROM learns JOIN customer ON CAST(c_custkey AS VARCHAR) = from_id WHERE so <= c_custkey * 40.0"


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.graph_ops import stats

    return stats(bindings.event_graph(spark, sf_dir)).drop("traits")


QUERIES["q03_graph_stats"] = graph_stats
ORACLE_SQL["q03_graph_stats"] = f"WITH {EVENTS} SELECT work_id, count(DISTINCT from_id) AS characters, count(DISTINCT to_id) AS facts, count_if(event_type IN ('click', 'view')) AS events, count(DISTINCT to_id) AS items, count(*) AS related FROM e GROUP BY work_id"


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.graph_ops import search

    chunks = bindings.read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role", F.col("text").alias("content"))
    return search(chunks, bindings.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5)


QUERIES["q04_keyword_search"] = keyword_search
ORACLE_SQL["q04_keyword_search"] = """WITH q AS (SELECT item_id AS query_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF x <> '']) AS word FROM benchmark), d AS (SELECT DISTINCT word FROM q),
  c AS (SELECT conv_id || '-' || turn AS id, conv_id * 1000 + turn AS seq, lower(text) AS low FROM conversations),
  h AS (SELECT id, seq, word FROM c JOIN d ON contains(low, word)), s AS (SELECT query_id, id, seq, CAST(count(*) AS BIGINT) AS score FROM q JOIN h USING (word) GROUP BY ALL)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, id) AS rank, id, score FROM s QUALIFY rank <= 5"""


def removed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left when the facts of every fifth k are taken as one source and removed."""
    from dataclasses import replace

    from storyloom.operators.graph_ops import remove_sources

    g = bindings.event_graph(spark, sf_dir)
    source = F.when(F.col("id").cast("long") % 5 == 0, "s1").otherwise("s2")
    g = replace(g, facts=g.facts.withColumn("source_id", source), items=g.items.withColumn("source_id", source))
    left = remove_sources(g, spark.createDataFrame([("s1",)], "source_id string"))
    return left.learns.groupBy("work_id").agg(F.count("*").alias("edges"), F.countDistinct("to_id").alias("facts"))


QUERIES["m01_remove_source"] = removed_source
ORACLE_SQL["m01_remove_source"] = f"WITH {EVENTS} SELECT work_id, count(*) AS edges, count(DISTINCT to_id) AS facts FROM learns WHERE CAST(to_id AS BIGINT) % 5 <> 0 OR EXISTS (SELECT 1 FROM people p WHERE p.work_id = learns.work_id AND p.id = to_id) OR EXISTS (SELECT 1 FROM e c WHERE c.work_id = learns.work_id AND c.event_type IN ('click', 'view') AND CAST(c.seq AS VARCHAR) = learns.to_id) GROUP BY work_id"


def marked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.graph_ops import mark_intentional

    g = bindings.event_graph(spark, sf_dir)
    marks = g.characters.where(F.col("id").cast("long") % 3 == 0).select("work_id", "id", F.concat(F.lit("c"), "id").alias("confirmation_id"))
    return mark_intentional(g.feels, marks).groupBy("work_id", "confirmed_intentional").agg(F.count("*").alias("edges"), F.countDistinct("confirmation_id").alias("confirmations"))


QUERIES["m05_mark_intentional"] = marked_edges
ORACLE_SQL["m05_mark_intentional"] = f"""WITH {EVENTS}, m AS (SELECT work_id, id FROM people WHERE CAST(id AS BIGINT) % 3 = 0),
  f AS (SELECT e.work_id, coalesce(a.id, b.id) AS hit FROM e LEFT JOIN m a ON a.work_id = e.work_id AND a.id = e.from_id LEFT JOIN m b ON b.work_id = e.work_id AND b.id = e.to_id)
  SELECT work_id, CASE WHEN hit IS NOT NULL THEN true END AS confirmed_intentional, count(*) AS edges, count(DISTINCT hit) AS confirmations FROM f GROUP BY ALL"""


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.chunks import chunk

    docs = bindings.read(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk(docs).select("doc_id", "chunk_index", F.md5("content").alias("md5"), "chapter")


QUERIES["t01_chunks"] = document_chunks
ORACLE_SQL["t01_chunks"] = """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents WHERE length(trim(text)) >= 10),
  c AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 500) / 400.0) AS BIGINT)) + 1)) AS chunk_index FROM t)
  SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, md5(array_to_string(list_slice(w, chunk_index * 400 + 1, chunk_index * 400 + 500), ' ')) AS md5, CAST(NULL AS VARCHAR) AS chapter FROM c"""


def normalized_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.functions.text import contains_negation, normalize_text, semantic_tokens, subject_keywords

    c = bindings.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(normalize_text("text")).alias("normal"), contains_negation("text").alias("negated"), F.size(semantic_tokens("text")).alias("tokens"), F.array_join(subject_keywords("text"), " ").alias("keywords"))


QUERIES["t04_normalized_text"] = normalized_turns


#: Latin letters as Korean syllables with which words end, deny or begin, so that the rules for Korean words have work.
LETTERS, SYLLABLES = "etanosrihlducm", "다은는이가을를의와과못않없민"


def _korean(c: str) -> Column:
    return F.translate(F.coalesce(F.col(c), F.lit("")), LETTERS, SYLLABLES)


def korean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns spelt in Korean syllables: normal text, words, negation, keywords, and how alike a turn and the one before are."""
    from pyspark.sql import Window

    from storyloom.functions import text as T

    # each turn's words and pairs are made once, where its conversation is, and the next turn takes them from there
    joined = lambda a: F.md5(F.array_join(F.array_sort(a), " "))
    c = bindings.read(spark, sf_dir, "conversations").select("conv_id", "turn", _korean("text").alias("k")).repartition("conv_id").withColumn("normal", T.normalize_text("k"))
    c = c.select("conv_id", "turn", "k", "normal", T.normal_tokens("normal").alias("ws"), T.fact_bigrams("k").alias("ps"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumns({"bs": F.coalesce(F.lag("ws").over(w), F.array().cast("array<string>")), "qs": F.coalesce(F.lag("ps").over(w), F.array(F.lit("")))})
    return c.select(
        "conv_id", "turn", F.md5("normal").alias("normal"), joined("ws").alias("words"), joined(T.without_negations("ws")).alias("core"), T.normal_negation("normal").alias("negated"),
        F.array_join(T.subject_keywords("k"), " ").alias("subjects"), joined(T.report_keywords("k")).alias("report"), joined(T.hangul_words("k")).alias("hangul"),
        F.round(T.jaccard("bs", "ws"), 6).alias("shared"), F.round(T.jaccard("qs", "ps"), 6).alias("similarity"),
    )


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _cut_sql(x: str, suffixes: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 1} THEN left({x}, length({x}) - {len(s)})" for s in suffixes) + f" ELSE {x} END"


def _normal_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim({x}, e' \t\n\r')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _tokens_sql(x: str, stop: list[str]) -> str:
    return f"list_distinct([w FOR w IN [{_cut_sql('v', L.TOKEN_SUFFIXES)} FOR v IN regexp_extract_all({_normal_sql(x)}, '[가-힣A-Za-z0-9]+')] IF w NOT IN ({_listed(stop)}) AND w <> ''])"


def _alike_sql(a: str, b: str) -> str:
    return f"round(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END, 6)"


def _pairs_sql(x: str) -> str:
    bare = rf"trim(regexp_replace(regexp_replace(regexp_replace(trim({x}, e' \t\n\r'), '[.!?,。、·…]', ' ', 'g'), '([가-힣])(?:이야|이다|이에요|이었|이고|이며|이랑|야|다|해요|했다|해|ㅎ)+', '\1 ', 'g'), '\s+', ' ', 'g'))"
    return f"[CASE WHEN length(t) >= 2 THEN list_distinct([substr(t, i, 2) FOR i IN range(1, length(t))]) ELSE [t] END FOR t IN [{bare}]][1]"


def _report_words_sql(x: str) -> str:
    bare = "w"
    for ending in L.REPORT_ENDINGS:
        bare = f"regexp_replace({bare}, '({ending})$', '')"
    return rf"list_distinct(list_concat([v FOR v IN [{bare} FOR w IN regexp_extract_all({x}, '[가-힣]+')] IF length(v) >= 2], regexp_extract_all({x}, '[0-9]+[분시간일월년]')))"


QUERIES["t05_korean_words"] = korean_words
ORACLE_SQL["t05_korean_words"] = rf"""WITH c AS (SELECT conv_id, turn, translate(coalesce(text, ''), '{LETTERS}', '{SYLLABLES}') AS k FROM conversations),
  b AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM c),
  w AS (SELECT *, {_tokens_sql("k", L.SEMANTIC_STOP)} AS ws, {_tokens_sql("before", L.SEMANTIC_STOP)} AS bs, {_pairs_sql("k")} AS ps, {_pairs_sql("before")} AS qs,
    [x FOR x IN [{_cut_sql("v", sorted(L.PARTICLES, key=len, reverse=True))} FOR v IN regexp_extract_all(k, '[가-힣A-Za-z0-9]+')] IF length(x) >= 2 AND x NOT IN ({_listed(L.CONTENT_STOP)})] AS sk FROM b)
  SELECT conv_id, turn, md5({_normal_sql("k")}) AS normal, md5(array_to_string(list_sort(ws), ' ')) AS words, md5(array_to_string(list_sort({_tokens_sql("k", L.SEMANTIC_STOP + L.NEGATIONS)}), ' ')) AS core,
    len([x FOR x IN string_split({_normal_sql("k")}, ' ') IF x IN ({_listed(L.NEGATIONS)}) OR regexp_matches(x, '^({"|".join(L.NEGATION_PREFIXES)})')]) > 0 AS negated,
    array_to_string([sk[i] FOR i IN range(1, len(sk) + 1) IF list_position(sk, sk[i]) = i][1:5], ' ') AS subjects, md5(array_to_string(list_sort({_report_words_sql("k")}), ' ')) AS report,
    md5(array_to_string(list_sort(list_distinct(regexp_extract_all(k, '[가-힣]{{2,}}'))), ' ')) AS hangul, {_alike_sql("bs", "ws")} AS shared, {_alike_sql("qs", "ps")} AS similarity FROM w"""


def fact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that follow each other, with the similarity of their character pairs."""
    from pyspark.sql import Window

    from storyloom.functions.text import fact_similarity

    c = bindings.read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("before IS NOT NULL").select("conv_id", "turn", F.round(fact_similarity("before", "text"), 6).alias("similarity"))


QUERIES["t10_fact_similarity"] = fact_pairs


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: a case for each customer, a set for each nation; status F counts as found, P as missed, O as wrong."""
    o = bindings.read(spark, sf_dir, "orders").join(bindings.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = bindings.read(spark, sf_dir, "nation")
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("set"), F.col("c_custkey").alias("case")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("tp"), F.count_if(F.col("o_orderstatus") == "P").alias("fn"), F.count_if(F.col("o_orderstatus") == "O").alias("fp"))


def scores_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.evaluate import by_set

    return by_set(_runs(spark, sf_dir))


QUERIES["x04_scores_by_set"] = scores_by_set
ORACLE_SQL["x04_scores_by_set"] = """WITH r AS (SELECT n_name AS set, count_if(o_orderstatus = 'F') AS tp, count_if(o_orderstatus = 'O') AS fp, count_if(o_orderstatus = 'P') AS fn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)),
  s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM r)
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s"""


def expected_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.evaluate import expected_and_detected

    r = _runs(spark, sf_dir).select(F.col("set").alias("group"), F.col("case").cast("string").alias("case"), (F.col("tp") + F.col("fn")).alias("expected"), (F.col("tp") + F.col("fp")).alias("total"), F.when(F.col("case") % 50 == 0, "timeout").alias("error"))
    return expected_and_detected(r)


QUERIES["x10_expected_detected"] = expected_detected
ORACLE_SQL["x10_expected_detected"] = """WITH r AS (SELECT n_name AS "group", CAST(c_custkey AS VARCHAR) AS "case", count_if(o_orderstatus IN ('F', 'P')) AS expected, count_if(o_orderstatus IN ('F', 'O')) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 0 GROUP BY ALL)
  SELECT "group", "case", CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(total) AS BIGINT) AS detected, CAST(sum(total) - sum(expected) AS BIGINT) AS diff FROM r GROUP BY ROLLUP ("group", "case")"""


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.evaluate import token_cost

    model = F.when(F.col("o_orderstatus") == "F", "small").when(F.col("o_orderstatus") == "O", "large").otherwise("other")
    return token_cost(bindings.read(spark, sf_dir, "orders").select(model.alias("model"), (F.col("o_orderkey") % 5000).alias("prompt_tokens"), (F.col("o_custkey") % 900).alias("completion_tokens")))


QUERIES["x12_token_cost"] = usage_cost
ORACLE_SQL["x12_token_cost"] = """WITH u AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'small' WHEN 'O' THEN 'large' ELSE 'other' END AS model, o_orderkey % 5000 AS p, o_custkey % 900 AS c FROM orders),
  k AS (SELECT model, p, c, CASE model WHEN 'small' THEN 0.15::DOUBLE WHEN 'large' THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS pp, CASE model WHEN 'small' THEN 0.6::DOUBLE WHEN 'large' THEN 10.0::DOUBLE ELSE 3.0::DOUBLE END AS cp FROM u)
  SELECT model, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, round(sum(p * pp / 1000000 + c * cp / 1000000), 6) AS cost FROM k GROUP BY ROLLUP (model)"""


def detection_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold: benchmark items with their distinct words as keywords; detections: documents, in sixteen cases."""
    from storyloom.operators.evaluate import assign

    kw = F.filter(F.array_distinct(F.split("text", r"\s+")), lambda w: w != "")
    gold = bindings.read(spark, sf_dir, "benchmark").select((F.col("item_id") % 16).cast("string").alias("case"), F.col("item_id").cast("string").alias("gid"), F.col("item_id").alias("seq"), kw.alias("keywords"), F.lit("timeline").alias("category"), F.lit("hard").alias("hard_soft"))
    docs = bindings.read(spark, sf_dir, "documents").select((F.col("doc_id") % 16).cast("string").alias("case"), F.col("doc_id").cast("string").alias("vid"), F.col("doc_id").alias("seq"), "text", (F.col("doc_id") % 2 == 0).alias("is_hard"))
    return assign(docs, gold, 0.8)


QUERIES["x02_detection_matches"] = detection_matches


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over the event graph, consolidated."""
    from storyloom.operators.consolidate import consolidate

    return report(consolidate(rules.scan(bindings.event_graph(spark, sf_dir))))


QUERIES["c01_full_scan"] = full_scan


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 over the event graph with its traits: totals of reports and confirmations after all steps."""
    from storyloom.plans.analysis import full_scan as whole

    g = bindings.habit_graph(spark, sf_dir)
    none = spark.createDataFrame([], "work_id string, chunk_id string, text string, seq long")
    return whole(g, none)["summary"]


QUERIES["c14_analysed"] = analysed


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scripts: a chunk for each turn, ``role: sentence`` a line; a work for each conversation."""
    c = bindings.read(spark, sf_dir, "conversations")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.initcap("role"), F.lit(": "), x)), "\n")
    return c.select(F.col("conv_id").cast("string").alias("work_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.lit("scenario").alias("source_type"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), lines.alias("text"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.extract import extract

    out = None
    for kind, rows in extract(_chunks(spark, sf_dir)).items():
        one = rows.groupBy("work_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.union(one)
    return out


QUERIES["e10_extracted"] = extracted


def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.extract import facts
    from storyloom.operators.normalize import merge_facts

    return merge_facts(facts(_chunks(spark, sf_dir))).select("work_id", "content", "category", F.size("merged_from").alias("members"), "seq")


QUERIES["n05_merged_facts"] = merged_facts


def merged_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.normalize import characters

    p = bindings.read(spark, sf_dir, "part").select((F.col("p_partkey") % 8).cast("string").alias("work_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name"), F.col("p_partkey").cast("string").alias("source_chunk_id"), F.col("p_partkey").alias("seq"))
    return characters(p).select("work_id", "name", F.array_join("aliases", "|").alias("aliases"), F.size("merged_from").alias("members"), "seq")


QUERIES["n02_merged_characters"] = merged_characters
ORACLE_SQL["n02_merged_characters"] = """WITH p AS (SELECT CAST(p_partkey % 8 AS VARCHAR) AS work_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name, p_partkey AS seq FROM part),
  g AS (SELECT work_id, arg_min(name, seq) AS name, list_sort(list(DISTINCT name)) AS spelt, CAST(count(*) AS INT) AS members, min(seq) AS seq FROM p GROUP BY work_id, lower(replace(name, ' ', '')))
  SELECT work_id, name, array_to_string([x FOR x IN spelt IF x <> name], '|') AS aliases, members, seq FROM g"""


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.normalize import events

    e = bindings.read(spark, sf_dir, "events")
    raw = e.select((F.col("user_id") % 8).cast("string").alias("work_id"), F.concat(F.lit(" "), "event_type").alias("description"), F.get_json_object("props", "$.k").alias("location_hint"), F.array(F.col("user_id").cast("string")).alias("characters_involved"), F.col("event_type"), F.lit(None).cast("string").alias("status_char"), F.col("event_id").cast("string").alias("source_chunk_id"), F.col("event_id").alias("seq"))
    return events(raw).select("work_id", "description", "location", F.array_join("characters_involved", ",").alias("who"), "source_chunk_id", "seq")


QUERIES["n06_merged_events"] = merged_events
ORACLE_SQL["n06_merged_events"] = """WITH e AS (SELECT CAST(user_id % 8 AS VARCHAR) AS work_id, event_type AS description, json_extract_string(props, '$.k') AS location, CAST(user_id AS VARCHAR) AS u, event_id FROM events),
  f AS (SELECT work_id, description, location, u, min(event_id) AS first FROM e GROUP BY ALL)
  SELECT work_id, description, location, string_agg(u, ',' ORDER BY first) AS who, CAST(min(first) AS VARCHAR) AS source_chunk_id, min(first) AS seq FROM f GROUP BY ALL"""


def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.operators.extract import facts
    from storyloom.operators.normalize import source_conflicts as conflicts

    return conflicts(facts(_chunks(spark, sf_dir))).select("work_id", "topic", F.size("conflicting_values").alias("values"))


QUERIES["n07_source_conflicts"] = source_conflicts


def built_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through extraction, normalisation and materialisation: rows of each kind in each work."""
    from storyloom.operators import extract, materialize, normalize
    from storyloom.plans.graph import saved, saved_tables

    raw = saved_tables(extract.extract(_chunks(spark, sf_dir)))
    n = raw | saved_tables({"characters": normalize.characters(raw["characters"]), "facts": normalize.merge_facts(raw["facts"]), "events": normalize.events(raw["events"])})
    return materialize.created(saved(materialize.materialize(spark, n)))


QUERIES["g15_built_graph"] = built_graph
