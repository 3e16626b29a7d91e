"""A corpus build from ``documents``: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontam, langid, linededup, ngramjoin, packing
from storyloom.llm.shared import table, written
from storyloom.llm.tokens import default_tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, those of which no language has half the letters, and those that fit none well go."""
    model = langid.train(docs)
    return langid.identify(docs, model).where("lang_pred <> 'und' AND score >= 0.5").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line of a group of near-equal lines stays once in the corpus; documents that had no other line go."""
    kept = linededup.dedup_lines(docs).where("n_removed = 0 OR text RLIKE '[^\\\\s]'")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar by 0.8 or more, the one of the smallest key stays;
    null keys come last. Of rows equal in key and text any one stays. Documents without words are in no group."""
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = ngramjoin.ngram_join(rows, n=5, num=80, den=100, id_col="__row").where("n_shingles > 0").withColumnRenamed("doc_id", "__row")
    several = found.groupBy("component_id").agg(F.count("*").alias("k")).where("k > 1").select("component_id")
    grouped = written(found.join(several, "component_id").groupBy("component_id", "__row").agg(F.count("*").alias("k")))
    keys = rows.select("__row", "doc_id").join(grouped, "__row").groupBy("component_id", "__row").agg(F.min("doc_id").alias("key"))
    first = keys.groupBy("component_id").agg(F.min_by("__row", F.struct(F.col("key").isNull(), "key", "__row")).alias("__row")).select("__row", F.lit(True).alias("first"))
    marked = written(grouped.join(first, "__row", "left").where("first IS NULL OR k > 1").select("__row", "first"))
    alone = rows.join(marked, "__row", "left_anti")
    repeated = rows.join(marked.where("first"), "__row", "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(repeated).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    leaks = decontam.find_leaks(docs, decontam.question_answer(table(spark, sf_dir, "benchmark")))
    gone = written(leaks.select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in training sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, default_tokenizer()))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
