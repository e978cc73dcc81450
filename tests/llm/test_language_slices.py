"""The language model in many slices against the definition."""

from __future__ import annotations

import numpy as np

from scholarflow.llm import op1_language

from .test_operators import _ppm_brute


def test_no_count_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(op1_language, "MAX_CELLS", 60)
    train = {"en": ["the cat sat on the mat", "the dog and the hat"], "fr": ["le chat est sur la table", "la pomme est ici"], "de": ["der hund und die katze sitzen hier"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    model = op1_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in ("the mat", "le chien", "zzz", "die pomme und the cat", "été"):
        want = _ppm_brute(train, text)
        got, _ = model.bits(text)
        assert np.allclose(got, [want[x] for x in model.langs], rtol=1e-5)
    assert len(model.files) > 3


def test_a_language_of_uniform_counts_survives(spark, monkeypatch):
    monkeypatch.setattr(op1_language, "HELD", 50)
    rare = "abcdefghijklmnopqrstuvwxyz"
    docs = spark.createDataFrame([(rare, "aa")] + [(f"the cat number {k} sat on the mat with {k * k} rats " * 30, "bb") for k in range(40)], "text string, lang string")
    model = op1_language.train(docs)
    assert model.langs == ["aa", "bb"]
    got = op1_language.identify(spark.createDataFrame([("klmnopqrstuv",), ("the cat sat on the rats",)], "text string"), model).collect()
    assert [r["_out"]["lang_pred"] for r in got] == ["aa", "bb"]


def test_texts_over_a_chunk(spark):
    text = "der hund und die katze " * (op1_language.CHUNK // 20)
    assert len(text) > op1_language.CHUNK
    docs = spark.createDataFrame([(text, "de"), ("the dog and the cat " * 100, "en")], "text string, lang string")
    counts = {r["gram"]: r["n"] for r in op1_language.count_grams(docs).filter("lang = 'de'").collect()}
    raw = b"\n\n\n" + text.encode()
    assert sum(counts.values()) == len(text) and counts[int.from_bytes(b"hund", "big")] == raw.count(b"hund")
    model = op1_language.train(docs)
    bits, n = model.bits(text)
    assert n == len(text) and bits[0] < bits[1]
