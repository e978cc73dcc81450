"""The stages of the pipeline, one by one and together."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from scholarflow.llm import near_copies, op2_secrets
from scholarflow.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names that the operators use inside.
CLASHES = ["_out", "_id", "_h", "_hash", "_p", "_size", "_bin", "_word", "row", "hash", "key", "k", "cls", "maybe", "target", "rest", "full", "picks", "end_bin", "end_h", "over_h", "source_size", "copies", "size", "lang_pred", "redacted", "root", "kept_id"]


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "1 2 3", "en", "src0", 5), (10**6 + 2, "", None, "src1", 0)], docs.schema))
    docs = docs.unionByName(docs.limit(1))
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.columns == COLUMNS and kept.count() == docs.count() - 3
    one = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    # the stage follows five-word shingles at 0.8; test_near_copies.py holds it against brute force
    groups = near_copies.groups(kept).select("root").distinct().count()
    assert one.columns == COLUMNS and one.count() == groups == one.select("doc_id").distinct().count()
    clean = corpus_pipeline.secrets(spark, one, sf_dir)
    rows = clean.collect()
    assert clean.columns == COLUMNS and len(rows) == groups and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any(any(op2_secrets.find(r["text"])) for r in rows)
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    assert all(r["text"] == before[r["doc_id"]] for r in rows if not any(op2_secrets.find(before[r["doc_id"]])))
    mixed = corpus_pipeline.mixing(spark, clean, sf_dir)
    assert mixed.columns == COLUMNS and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    out = corpus_pipeline.pieces(spark, mixed, sf_dir)
    assert out.count() == mixed.count() and all(r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


@pytest.mark.parametrize("name", ["language", "near_duplicates", "secrets", "mixing"])
def test_clashing_columns_come_back(spark, sf_dir, name):
    docs = table(spark, sf_dir, "documents").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "a null id here", "en", "src0", 14), (7, None, None, None, None)], docs.schema))
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    out = dict(corpus_pipeline.STAGES)[name](spark, wide, sf_dir)
    assert out.columns == wide.columns
    rows = out.collect()
    assert len(rows) > 20
    for r in rows:
        assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES)


def test_the_session_keeps_its_batch_size(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "64m")
    try:
        corpus_pipeline.near_duplicates(spark, table(spark, sf_dir, "documents").limit(20), sf_dir).count()
        assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
