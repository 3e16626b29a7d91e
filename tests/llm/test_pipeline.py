"""The pipeline's stages in order, each over what the one before has kept."""

import re

import corpus_pipeline
import pandas as pd

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.toPandas()
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    plain = lambda s: " " + " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        after = out.toPandas()
        assert set(after.doc_id) <= set(kept.doc_id)
        if i == 3:
            leaks = {d for d, t in zip(kept.doc_id, kept.text) if any(plain(b) in plain(t) for b in bench.text)}
            assert set(kept.doc_id) - set(after.doc_id) == leaks
        kept, docs = after, spark.createDataFrame(after, docs.schema)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(placed.doc_id) == set(kept.doc_id)
    assert placed.sequence_id.nunique() <= -(-placed.length.sum() // 2048) + 1


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, null keys, equal keys with other texts, texts without words, and near copies against brute force."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["other"])
    other = " ".join(f"v{i}" for i in range(30))
    last = " ".join(f"u{i}" for i in range(30))
    rows = [(7, " ".join(base)), (7, " ".join(base)), (9, near), (None, near), (3, other), (3, other), (3, last), (None, "only null keys"), (None, "only null keys"), (4, ""), (4, ""), (5, None)]
    out = corpus_pipeline.join_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    want = [(7, " ".join(base)), (3, other), (3, last), (None, "only null keys"), (4, ""), (4, ""), (5, None)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert corpus_pipeline.join_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), SF).count() == 0
