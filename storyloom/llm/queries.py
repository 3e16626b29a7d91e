"""The registered queries of this package: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import chat, decontam, langid, lexical, linededup, neardup, ngramjoin, packing, pii, resampling, secrets, shards, tokencounts
from storyloom.llm.shared import table
from storyloom.llm.tokens import default_tokenizer


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), decontam.question_answer(table(spark, sf_dir, "benchmark")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.token_counts(table(spark, sf_dir, "documents"), tokencounts.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), default_tokenizer()))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.read_shards(shards.write_shards(table(spark, sf_dir, "documents"), default_tokenizer()))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(secrets.joined(["assign", "access", "hex"]), 256)
    return found.select("doc_id", *sizes, base.alias("base_sha256"), secrets.joined(["assign", "access", "hex", "markov"]).alias("spans"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_spans")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.chat_digests(chat.format_chats(turns.union(more)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_token_counts, op4_pii, op5_best_fit_packing, op6_token_shards, op7_secret_scan, op8_embedding_near_dedup, op9_line_dedup, op10_language_id, op11_importance_resampling, op12_chat_formatting, op13_lexical_search)}

#: The steps of the CRC over one byte, in SQL: eight halvings of each byte, by its rule.
CRC_STEPS = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
CHAT_CONTROL = r"<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op11_importance_resampling": rf"""
WITH steps AS MATERIALIZED (SELECT {CRC_STEPS} AS step),
own AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
aim AS (SELECT unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
words AS (SELECT r, unnest(ws) AS w FROM own),
counted AS (SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT w, count(*) AS s, 0 AS t FROM words GROUP BY w UNION ALL SELECT w, 0, count(*) FROM aim GROUP BY w) GROUP BY w),
bytes AS (SELECT w, s, t, hex(encode(w)) AS h FROM counted),
hashed AS (SELECT w, s, t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1]))) % 10000 AS bucket FROM bytes, steps),
buckets AS (SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM hashed GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::BIGINT AS all_s, coalesce(sum(t), 0)::BIGINT AS all_t FROM buckets),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (all_t + 10000.0::DOUBLE))))::BIGINT AS g FROM buckets, total),
weighed AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM own LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS "rank" FROM ranked""",
    "op12_chat_formatting": rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, 24 + length(role) + length(text) + length(role || text) - length(replace(role || text, chr(92), '')) + length(role) - length(replace(role, chr(10), ''))
  + len(regexp_extract_all(role, '{CHAT_CONTROL}')) + len(regexp_extract_all(text, '{CHAT_CONTROL}')) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, (sum(chars) + 7)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op13_lexical_search": rf"""
WITH words AS (SELECT r, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM (SELECT row_number() OVER () AS r, text FROM documents)),
tfs AS (SELECT r, w, count(*)::BIGINT AS tf FROM words GROUP BY r, w),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tfs GROUP BY r),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_words FROM sizes),
dfs AS (SELECT w, count(*)::BIGINT AS df FROM tfs GROUP BY w),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
scored AS (SELECT item_id, r, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // all_words))))::BIGINT AS score
  FROM asked JOIN tfs USING (w) JOIN dfs USING (w) JOIN sizes USING (r), total GROUP BY item_id, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k
  FROM scored JOIN (SELECT row_number() OVER () AS r, doc_id FROM documents) USING (r) WHERE score > 0)
SELECT item_id, k::INTEGER AS "rank", doc_id, score FROM ranked WHERE k <= 10""",
}
