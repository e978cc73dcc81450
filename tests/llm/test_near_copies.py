"""Near copies against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from scholarflow.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    k = min(5, len(words))
    return frozenset(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(rows):
    """The smallest doc_id of each group that similarities of 0.8 or more join."""
    sets = {r[0]: words_of(r[1]) for r in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {top(i) for i in sets}


def planted():
    """Originals with copies in which up to a tenth of the words is changed, and chains of copies of copies."""
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 40, 100, 400]))]
        rows.append(" ".join(words))
        for changes in (1, 2, 3, 6, 12):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(len(copy) - 1, changes)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
            if changes == 2:
                words = copy
    rng.shuffle(rows)
    return [(i, t, "en", "src0", len(t)) for i, t in enumerate(rows)]


def test_planted_near_copies_go(spark, sf_dir):
    rows = planted()
    want = brute(rows)
    assert len(want) < 0.9 * len(rows)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == want and kept.count() == len(want)


def test_documents_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_links_take_the_radius_that_is_asked_for(spark):
    from scholarflow.llm import op9_simhash

    for prints, radius, joined in (((0, 7, 63), 2, 0), ((0, 7, 63), 3, 3), ((0, 63), 5, 0), ((0, 63), 6, 2)):
        links = op9_simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), radius)
        assert len({x for r in links.collect() for x in r}) == joined
