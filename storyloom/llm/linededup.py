"""Fuzzy line deduplication with DataFrame functions alone: MinHash banding, exact Jaccard verification, connected components.

Lines are compared by their sets of character shingles. MinHash signatures come from all shingles, banding proposes
groups, and the exact Jaccard similarity decides. Each line of a band meets the band's smallest line first, which joins most
groups without their pairs. Where a band's lines are still apart, those outside its largest component meet all lines of other components:
two lines that are apart are not both in the largest, so no pair of a band is left out. These pairs are made block by block and
only those written that the difference of two bitmaps allows. Connected lines are one component, of which the first occurrence stays.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.components import components
from storyloom.llm.linepostings import _Postings, _shingles  # noqa: F401  (tests find them here)
from storyloom.llm.shared import removed, written

SHINGLE = 8
#: Shingles that one row hashes at once.
WINDOW = 4
#: Nine minima are the points of the affine plane of order three and its twelve lines are the bands, so any five equal
#: minima hold a band: a pair at similarity 0.8 shares one with probability 0.99.
MINIMA = 9
BANDS = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6)]
#: Lines of a block: those outside a band's largest component meet the band so many at a time.
BLOCK_LINES = 2048
#: Words of 64 bits in a line's bitmap, and in the folded one that is compared first.
WORDS, FOLDED = 32, 8


def _masks(n: int) -> list[int]:
    """``n`` signed 64-bit masks whose first four bits differ, so that the minima of a hash XOR each come from different parts
    of the hashes."""
    draw = random.Random(0)
    firsts = [k * 16 // n for k in range(n)]
    return [(f << 60 | draw.getrandbits(60)) - (f >> 3 << 64) for f in firsts]


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rid (names a row's key and text), no, line, id (names the line): all lines but blank ones."""
    # each text is hashed and split once: in one projection with its lines it would be hashed for each, and an inner explode
    # adds a filter that splits it again; a line is blank if nothing is left of its start
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("rid"), F.split(text_col, "\n").alias("lines"))
    each = rows.select("doc_id", "rid", F.posexplode_outer("lines").alias("no", "line"))
    return each.where("trim(LEADING ' \t\r\x0b\x0c' FROM line) <> ''").withColumn("id", F.xxhash64("line"))


def _shingled(lines: DataFrame, window: int) -> DataFrame:
    """id and the hashes h0, h1, ... of ``window`` shingles a row, the last ones repeated. A line is taken at four bytes a character, so
    that any shingle is found at once; one shorter than a shingle is its own only one."""
    placed = lines.select("id", F.encode("line", "UTF-32").alias("b")).withColumn("last", F.expr(f"greatest(0, CAST(length(b) / 4 AS INT) - {SHINGLE})"))
    rows = placed.select("id", "b", "last", F.explode(F.expr(f"sequence(0, last, {window})")).alias("p"))
    return rows.select("id", *[F.expr(f"xxhash64(substring(b, 4 * least(p + {i}, last) + 1, {4 * SHINGLE}))").alias(f"h{i}") for i in range(window)])


def _signed(lines: DataFrame) -> DataFrame:
    """id, bands: hashes of three MinHash values each, of the distinct lines."""
    low = [F.expr("least(" + ", ".join(f"h{i} ^ CAST('{m}' AS BIGINT)" for i in range(WINDOW)) + ")").alias(f"m{k}") for k, m in enumerate(_masks(MINIMA))]
    signed = _shingled(lines, WINDOW).select("id", *low).groupBy("id").agg(*[F.min(f"m{k}").alias(f"m{k}") for k in range(MINIMA)])
    return signed.select("id", F.array(*[F.xxhash64(F.lit(b), *(f"m{k}" for k in of)) for b, of in enumerate(BANDS)]).alias("bands"))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over all shuffle partitions: few bytes can be much work here, so small partitions stay apart."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of line ids that are similar enough. Texts are shuffled rather than their sets, which are many
    times as large."""
    both = _spread(pairs.join(texts.toDF("a", "x"), "a"), "b").join(texts.toDF("b", "y"), "b")
    # a lambda hands on what it is given and explode what it has made, so each line is encoded and each array made once
    hashes = f"transform(sequence(1, greatest(1, length(v) - {4 * SHINGLE - 1}), 4), p -> xxhash64(substring(v, p, {4 * SHINGLE})))"
    made = both.select("a", "b", F.explode(F.expr(f"array(transform(array(encode(x, 'UTF-32'), encode(y, 'UTF-32')), v -> {hashes}))")).alias("z"))
    return made.where(f"size(array_intersect(z[0], z[1])) * {den + num}L >= (size(array_distinct(z[0])) + size(array_distinct(z[1]))) * {num}L").select("a", "b")


def _bitmaps(lines: DataFrame) -> DataFrame:
    """id, n (shingles, repeats counted), v (WORDS words: a bitmap of the shingles' hashes), w0, w1, ...: its words folded to FOLDED."""
    some = _shingled(lines, 1).groupBy("id", F.expr(f"CAST((h0 >> 6) & {WORDS - 1} AS INT)").alias("k")).agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, CAST(h0 & 63 AS INT))")).alias("w"))
    maps = some.groupBy("id").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
    maps = maps.select("id", "n", F.expr(f"transform(sequence(0, {WORDS - 1}), k -> coalesce(try_element_at(m, k), 0L))").alias("v"))
    return maps.select("*", *[F.expr(" | ".join(f"v[{i}]" for i in range(k, WORDS, FOLDED))).alias(f"w{k}") for k in range(FOLDED)])


def _mixed(bands: DataFrame, found: DataFrame) -> DataFrame:
    """band, id, c, rest: the lines of ``bands`` (band, id; distinct) of several components c, of three or more lines; ``rest`` are those
    outside the band's largest component. Bands of the same lines are taken once."""
    of = found.select(F.col("node").alias("id"), F.col("component").alias("c"))
    rows = written(bands.join(of, "id", "left").select("band", "id", F.coalesce("c", "id").alias("c")))
    lot = rows.groupBy("band").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.count("*").alias("k"), F.min("id").alias("lo"), F.min("c").alias("c"), F.max("c").alias("d"))
    lot = lot.where("c < d AND k > 2").groupBy("x", "k", "lo").agg(F.min("band").alias("band")).select("band")
    rows = written(rows.join(lot, "band"))
    main = rows.groupBy("band", "c").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("c", F.struct("k", "c")).alias("main"))
    return written(rows.join(main, "band").withColumn("rest", F.expr("c <> main")).drop("main"))


def _near(rows: DataFrame, bits: DataFrame, num: int, den: int, block_lines: int) -> DataFrame:
    """id, other, far: of each line ``asked`` the lines of other components in its bands, but for those whose bitmaps show that they are
    not alike: each of the ``far`` bits that differ is a shingle that one of the two lacks."""
    count = lambda c, size: F.expr(f"CAST(ceil({c} / {size}) AS INT)")
    blocks = rows.groupBy("band").agg(count("count_if(asked)", block_lines).alias("m"), count("count(*)", 8 * block_lines).alias("k"))
    names = ["id", "c", "n", "v", *[f"w{k}" for k in range(FOLDED)]]
    dealt = written(rows.join(blocks, "band").join(bits, "id"))
    place = lambda seed, of: F.expr(f"CAST(pmod(xxhash64(id, {seed}), {of}) AS INT)")
    asked = dealt.where("asked").select("band", place(8, "m").alias("j"), F.explode(F.expr("sequence(0, k - 1)")).alias("i"), *[F.col(c).alias(f"{c}_") for c in names])
    others = dealt.select("band", F.explode(F.expr("sequence(0, m - 1)")).alias("j"), place(9, "k").alias("i"), "asked", *names)
    most = f"(n + n_) * {den - num}L"
    folded = " + ".join(f"bit_count(w{k} ^ w{k}_)" for k in range(FOLDED))
    met = _spread(asked, "band", "j", "i").join(others, ["band", "j", "i"]).where(f"c <> c_ AND (NOT asked OR id < id_) AND ({folded}) * {den + num}L <= {most}")
    far = "aggregate(zip_with(v, v_, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    # explode hands on what is made once
    near = met.select(F.col("id_").alias("id"), F.col("id").alias("other"), F.expr(most).alias("most"), F.explode(F.expr(f"array({far})")).alias("far"))
    return near.where(f"far * {den + num}L <= most").select("id", "other", "far")


def _links(bands: DataFrame, lead: DataFrame, texts: DataFrame, num: int, den: int, block_lines: int) -> DataFrame:
    """Links (a, b) that connect all lines of ``bands`` (band, id; distinct) that are alike and share a band; ``lead`` has each band's
    smallest line ``lo``. First lines meet the smallest of their bands, then those still apart the one line whose bitmap is nearest, then
    all lines from which they are still apart."""
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = written(bands.join(lead, "band").where("id <> lo").select(*pair("id", "lo")).distinct())
    links = written(_verified(tried, texts, num, den))
    rows = _mixed(bands, written(components(links)))
    bits = written(_bitmaps(texts.join(rows.select("id").distinct(), "id", "left_semi")))
    # a line is asked in its largest band alone
    own = rows.where("rest").join(rows.groupBy("band").agg(F.count("*").alias("k")), "band").groupBy("id").agg(F.max_by("band", F.struct("k", "band")).alias("own"))
    largest = written(rows.join(own, "id", "left").withColumn("asked", F.expr("rest AND band = own")))
    largest = written(largest.join(largest.where("asked").select("band").distinct(), "band", "left_semi"))
    nearest = _near(largest, bits, num, den, block_lines).groupBy("id").agg(F.min_by("other", "far").alias("other")).select(*pair("id", "other")).distinct()
    links = links.union(written(_verified(written(nearest.join(tried, ["a", "b"], "left_anti")), texts, num, den)))
    rows = _mixed(rows.select("band", "id"), written(components(links)))
    apart = _near(rows.withColumnRenamed("rest", "asked"), bits, num, den, block_lines).select(*pair("id", "other")).distinct().join(tried, ["a", "b"], "left_anti")
    return links.union(written(_verified(written(apart), texts, num, den)))


def _among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is one of ``keys`` (its one column), and few others: a bit table of 65,536 words, which is
    broadcast, keeps the rest out of a shuffle. However many keys there are, none of their rows is lost."""
    k = keys.columns[0]
    bits = keys.groupBy(F.shiftrightunsigned(k, 48).alias("__w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({k} & 63 AS INT))")).alias("__mask"))
    return rows.withColumn("__w", F.shiftrightunsigned(key, 48)).join(F.broadcast(bits), "__w").where(F.expr(f"shiftrightunsigned(__mask, CAST({key} & 63 AS INT)) & 1 = 1")).drop("__w", "__mask")


def _place() -> Column:
    """An occurrence's place in the corpus as one number, which hash aggregates can keep the smallest of: the document's
    key (null before all others), half of the row's hash, the line's number."""
    key = F.coalesce(F.col("doc_id").cast("decimal(20,0)") + F.expr("9223372036854775808BD"), F.lit(0).cast("decimal(20,0)"))
    rest = F.expr("shiftrightunsigned(rid, 33) * 2147483648 + no").cast("decimal(20,0)")
    return (key * F.expr("4611686018427387904BD") + rest).cast("decimal(38,0)")


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_lines: int = BLOCK_LINES) -> DataFrame:
    """``docs`` with duplicate lines taken out of the text, and n_lines, n_removed (0 for a null text).

    Of lines whose shingle sets have Jaccard similarity num / den or more, directly or through others, the first
    stays: that of the smallest document key, then of the smallest row hash, then the first in the text. A line under
    eight characters has itself as its only shingle, so only its copies go; blank lines stay. Rows equal in key and text
    count as one document and keep the same lines; keys are whole numbers, and null comes before all others. Banding finds
    a pair at similarity 0.8 with probability 0.99 and more above it, and each pair of a band is compared that others do not
    connect; lines and shingles are known by 64-bit hashes, and bytes that are not UTF-8 are all compared as one character. Columns n_lines and n_removed in ``docs`` are
    replaced.
    """
    lines = _lines(docs, id_col, text_col)
    occurrences = written(lines.drop("line"))
    first = written(occurrences.groupBy("id").agg(F.min(_place()).alias("first"), F.count("*").alias("k")))
    banded = written(_signed(lines))
    bands = banded.select("id", F.explode("bands").alias("band"))
    lead = written(bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band", "lo"))
    shared = written(_among(bands, "band", lead.select("band")).join(lead.select("band"), "band").select("band", "id"))
    removed(banded)
    # the text of a line is fetched once, from its first occurrence
    own = lambda place: F.xxhash64("id", place).alias("own")
    at = written(first.join(shared.select("id").distinct(), "id").select(own(F.col("first"))))
    texts = written(_among(lines.withColumn("own", own(_place())), "own", at).join(at, "own").dropDuplicates(["id"]).select("id", "line"))
    found = written(components(_links(shared, lead, texts, num, den, block_lines)))
    # the occurrences that go
    whole_first = first.join(found.withColumnRenamed("node", "id"), "id", "left")
    kept = whole_first.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("kept"))
    kept = written(whole_first.where("component IS NOT NULL OR k > 1").join(kept, "component", "left").select("id", F.coalesce("kept", "first").alias("kept")))
    gone = _among(occurrences, "id", kept.select("id")).join(kept, "id").where(_place() != F.col("kept")).select("rid", "no").distinct()
    lost = gone.groupBy("rid").agg(F.collect_list("no").alias("__lost")).withColumnRenamed("rid", "__rid")
    whole = docs.drop("n_lines", "n_removed").withColumn("__rid", _row_key(id_col, text_col)).join(lost.hint("shuffle_hash"), "__rid", "left").drop("__rid").withColumn("__lines", F.split(text_col, "\n"))
    kept_text = "array_join(transform(array_except(sequence(0, size(__lines) - 1), __lost), i -> element_at(__lines, i + 1)), '\\n')"
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    out = whole.withColumns({text_col: F.when(F.col("__lost").isNull(), F.col(text_col)).otherwise(F.expr(kept_text)), "n_lines": size("__lines"), "n_removed": size("__lost")})
    return out.drop("__lines", "__lost")
