"""The pipeline's language stage without labels."""

from __future__ import annotations

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_no_labels_drop_no_text_with_letters(spark, sf_dir):
    texts = ["the cat sat", "1 2 3", None, "", "le chat", "x1"]
    docs = spark.createDataFrame([(i, t, None, "src0", None) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.language(spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 4, 5] and all(r["lang"] is None for r in kept)
