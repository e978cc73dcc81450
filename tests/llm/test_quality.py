"""Statistics by brute force, and quality on documents that were held out."""

from __future__ import annotations

import math
import statistics as st
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarflow.llm import op3_quality
from scholarflow.llm.common import table


def _brute(text):
    raw = text.encode()
    words = raw.split()
    lengths = [len(w) for w in words]
    counts = Counter(words)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = raw.split(b"\n")
    share = lambda a, b: math.asin(math.sqrt(min(1, a / b)))
    odd = sum(1 for c in raw if 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()") + 0.5 * sum(chr(c) in "!?" for c in raw)
    p = [n / len(raw) for n in Counter(raw).values()]
    upper = sum(65 <= c <= 90 for c in raw)
    letters = upper + sum(97 <= c <= 122 or c >= 128 for c in raw)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(st.mean(lengths)), math.log1p(st.pstdev(lengths)),
        share(odd, len(raw)), share(upper, letters), share(sum(48 <= c <= 57 for c in raw), len(raw)), share(len(counts), len(words)),
        share(max(counts.values()), len(words)), share(sum(n <= 3 for n in lengths), len(words)), share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(raw) / len(lines)), share(len(triples) - len(set(triples)), len(triples)), -sum(x * math.log2(x) for x in p),
    ]


@pytest.mark.parametrize("text", ["The cat sat on the mat. The cat sat on the mat!\nAgain?\nAgain?", "a b c d 12 éà | | $$ & x", "one two three " * 50])
def test_statistics_by_brute_force(text):
    got = op3_quality.statistics(text)
    assert len(got) == len(op3_quality.STATISTICS) and np.allclose(got, _brute(text))


def test_held_out_quality(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    scores = op3_quality.op3_quality(spark, sf_dir).filter("held_out")
    rows = scores.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").filter("quality is not null").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert len(rows) > 80 and ((s >= 0.5) == y).mean() > 0.95
    good, bad = s[y == 1], s[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.98


def test_repeated_labels_count_again(spark):
    docs = spark.createDataFrame([(k, ("good words in a row here " if k % 2 else "x9 $$ || 77 ") * (k + 3)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once = {r["doc_id"]: r["predicted"] for r in op3_quality.quality_of_documents(docs, labels).collect()}
    twice = op3_quality.quality_of_documents(docs, labels.unionAll(labels)).select("doc_id", "predicted", F.col("score"))
    assert twice.count() == 40 and {r["doc_id"]: r["predicted"] for r in twice.collect()} == once == {k: k % 2 for k in range(40)}
