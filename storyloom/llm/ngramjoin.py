"""Set-similarity join of documents on word n-grams: rare-first prefixes with length, positional and suffix filters.

Copies (equal sets) are one class, and the join runs over classes. Frequencies for the rare-first order are counted
over all documents in a hashed table of fixed size; any global order gives exact results, a sharper one fewer
candidates. Candidates come in two rounds. First each posting of an n-gram meets that n-gram's leader, the posting
with the fewest rarer n-grams before it; the verified links already join large groups of near copies. Then classes
that are still in different components meet on every n-gram they share in their prefixes. Links inside a component
change nothing, so no link between components is lost, and a group is never expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.components import components
from storyloom.llm.shared import VECTOR, bounded, id_text, removed, vector_rows, vector_sum, written
from storyloom.llm.textkernel import Words, gram_sets, mix, pieces


def _frequencies(rows: DataFrame, n: int, bits: int) -> np.ndarray:
    def count(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for b in pieces(batches, "text"):
            _, g = gram_sets(Words(b.column("text"), lower=True), n)
            total += np.bincount((g >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield from vector_rows(total)

    return vector_sum(rows.select("text").mapInArrow(count, VECTOR), 1 << bits)


def _prefixes(rows: DataFrame, frequencies, n: int, num: int, den: int) -> DataFrame:
    """doc_id, c (a 64-bit name of the set), n, h0, h1 (counts of its n-grams in 16 hash classes, a byte each), prefix."""

    def cut(batches):
        freq = frequencies.value
        bits = len(freq).bit_length() - 1
        for b in pieces(batches, "text"):
            d, g = gram_sets(Words(b.column("text"), lower=True), n)
            k = b.num_rows
            size = np.bincount(d, minlength=k)
            name = np.zeros(k, dtype=np.uint64)
            np.add.at(name, d, mix(g ^ np.uint64(0xC2B2AE3D27D4EB4F)))
            name = mix(name + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            classes = np.minimum(np.bincount(d * 16 + (g & np.uint64(15)).astype(np.int64), minlength=k * 16).reshape(k, 16), 255).astype(np.uint8)
            halves = classes.view("<i8")
            order = np.lexsort((g, freq[(g >> np.uint64(64 - bits)).astype(np.int64)], d))
            first = np.concatenate([[0], np.cumsum(size)])
            length = np.where(size > 0, size - -(-size * num // den) + 1, 0)
            ends = np.cumsum(length)
            take = np.repeat(first[:-1] - (ends - length), length) + np.arange(ends[-1] if k else 0)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(g[order][take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(name.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), prefix], names=["doc_id", "c", "n", "h0", "h1", "prefix"])

    return rows.mapInArrow(cut, "doc_id long, c long, n long, h0 long, h1 long, prefix array<long>")


def _filters(num: int, den: int):
    """The condition on two postings a, b of one n-gram: length, positional, suffix."""
    both = F.col("a.n") + F.col("b.n")
    need = F.ceil(both * F.lit(num) / F.lit(num + den))
    apart = F.lit(0)
    for h in ("h0", "h1"):
        for k in range(0, 64, 8):
            x, y = (F.shiftrightunsigned(F.col(f"{s}.{h}"), k).bitwiseAND(F.lit(255)) for s in "ab")
            apart = apart + F.abs(x - y)
    return (
        (F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num)
        & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) * (num + den) >= both * num)
        & (apart <= both - need * 2)
    )


def _verified(pairs: DataFrame, rows: DataFrame, n: int, num: int, den: int, bits: int = 20) -> DataFrame:
    """The pairs (c_a, c_b, rep_a, rep_b) whose sets are similar enough. Only texts of documents in pairs are shuffled:
    a bit table of fixed size leaves out most others at the scan, and the joins are exact."""
    spark = rows.sparkSession
    ids = pairs.select(F.col("rep_a").alias("d")).union(pairs.select("rep_b"))

    def mark(batches):
        seen = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            seen[(mix(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = 1
        yield from vector_rows(seen)

    inside = spark.sparkContext.broadcast(vector_sum(ids.where("d is not null").mapInArrow(mark, VECTOR), 1 << bits) > 0)

    def some(batches):
        for b in batches:
            d = b.column("doc_id")
            at = (mix(pa.compute.fill_null(d, 0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            yield b.filter(pa.array(inside.value[at]))

    def check(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                sets = [gram_sets(Words(p.column(x), lower=True), n) for x in ("text_a", "text_b")]
                at = [np.searchsorted(d, np.arange(p.num_rows + 1)) for d, _ in sets]
                good = np.zeros(p.num_rows, dtype=bool)
                for i in range(p.num_rows):
                    x, y = (s[1][a[i] : a[i + 1]] for s, a in zip(sets, at))
                    both = np.sort(np.concatenate([x, y]))
                    same = int((both[1:] == both[:-1]).sum())
                    good[i] = same * den >= num * (len(both) - same) and len(both) > 0
                yield p.select(["c_a", "c_b"]).filter(pa.array(good))

    texts = rows.mapInArrow(some, "doc_id long, text string")
    left = texts.select(F.col("doc_id").alias("rep_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("rep_b"), F.col("text").alias("text_b"))
    return pairs.join(left, "rep_a").join(right, "rep_b").select("c_a", "c_b", "text_a", "text_b").mapInArrow(check, "c_a long, c_b long")


def _pairs(a: DataFrame, b: DataFrame, on, num: int, den: int) -> DataFrame:
    """The distinct pairs of classes that pass the filters, the smaller name first."""
    met = a.alias("a").join(b.alias("b"), on & _filters(num, den)).withColumn("turn", F.col("a.c") > F.col("b.c"))
    keep = (F.when(F.col("turn"), F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}")).alias(f"{c}_{x}") for c in ("c", "rep") for x, y in ("ab", "ba"))
    return met.select(*keep).distinct()


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, bits: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of Jaccard similarity >= num / den.

    Words are runs without ASCII white space, A-Z in lower case; a document with fewer than n words has its whole
    sequence as its one n-gram. A null or empty text has an empty set and is linked with nothing, itself its
    component; so has a null doc_id, whose component is the smallest other doc_id or null. Repeated rows stay, and
    equal texts are linked. Extra columns are left behind. Sets are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = id_text(docs, id_col, text_col)
    frequencies = spark.sparkContext.broadcast(np.minimum(_frequencies(rows, n, bits), 0xFFFFFFFF).astype(np.uint32))
    table = written(_prefixes(rows, frequencies, n, num, den))
    frequencies.destroy()
    known = written(table.select("doc_id", "c", "n"))
    classes = written(table.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("n", "h0", "h1"))))
    # postings stay narrow until those of n-grams that only one class has are gone
    postings = table.where("n > 0").groupBy("c").agg(F.first("prefix").alias("prefix")).select("c", F.posexplode("prefix").alias("pos", "token"))
    own = F.shiftleft(F.least("pos", F.lit(32767)).cast("long"), 48).bitwiseOR(F.shiftrightunsigned("c", 16))
    shared = postings.groupBy("token").agg(F.count("*").alias("k"), F.min(own).alias("lead")).where("k > 1").drop("k")
    narrow = written(postings.join(shared, "token").withColumn("leads", own == F.col("lead")).drop("lead"))
    removed(table)
    shared = written(narrow.join(classes, "c"))
    removed(narrow)
    rest, leaders = shared.where("not leads"), shared.where("leads")
    same = F.col("a.token") == F.col("b.token")
    tried = written(_pairs(rest, leaders, same, num, den))
    links = written(_verified(tried, rows, n, num, den))
    found = written(components(links))
    # what is still apart
    comp = shared.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    mixed = comp.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    apart = written(comp.join(mixed, "token").drop("leads"))
    short = apart.where(F.col("pos") * (num + den) <= F.col("n") * (den - num))
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.c") < F.col("b.c")))
    more = _pairs(short, apart, same & smaller & (F.col("a.component") != F.col("b.component")), num, den)
    more = written(more.join(tried, ["c_a", "c_b"], "left_anti"))
    if not more.isEmpty():
        added = written(_verified(more, rows, n, num, den))
        if not added.isEmpty():
            found = written(components(links.union(added)))
    # back to documents
    named = found.join(classes.select(F.col("c").alias("node"), "rep"), "node")
    lowest = named.groupBy("component").agg(F.min("rep").alias("lowest"))
    linked = named.join(lowest, "component").select(F.col("node").alias("c"), "lowest")
    of = classes.select("c", "rep").join(linked, "c", "left").select("c", F.coalesce("lowest", "rep").alias("component_id"))
    return known.select("doc_id", "n", "c").join(of, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
