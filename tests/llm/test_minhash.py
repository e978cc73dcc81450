"""Fingerprints against brute force."""

import hashlib

import numpy as np
import pytest

from scholarflow.llm import op11_minhash as op


def expected(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for rows with distinct ids, by whole texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        a, b, c = (op.fingerprint(x) for x in (t, edited, after))
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), op.likeness(a, b), op.likeness(a, c)))
    return out


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "gämma", "d", "epsilon", "ζ", "eta", "theta", "iota", "kappa", "la mbda", "mu\n"]
    return [" ".join(words[k] for k in rng.integers(0, len(words), rng.integers(0, 60))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


@pytest.mark.parametrize("order", ["in order", "shuffled", "in one part"])
def test_edited_texts_follow_the_ids_however_the_rows_lie(spark, monkeypatch, order):
    texts = [*made(60), None, "", "one", "two words", " \n ", "x" * 3000, "long " * 5000]
    rows = list(enumerate(texts, 5))
    if order == "shuffled":
        monkeypatch.setattr(op, "FEW", 3)
        rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1) if order == "in one part" else spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(op.fingerprints_of_documents(docs)) == sorted(expected(rows), key=str)


def test_null_ids_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b c d e f g"), (7, "q r s"), (7, "q r s"), (7, "other text"), (9, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, hash int, uid int, link int")
    got = [tuple(r) for r in op.fingerprints_of_documents(docs).collect()]
    assert sorted(str(r[0]) for r in got) == ["7", "7", "7", "9", "None"]
    halves = {t or "": [hashlib.sha256(((t or "")[: len(t or "") - len(t or "") // 2] + (a or "")[: len(t or "") // 2]).encode()).hexdigest() for _, a in rows] for _, t in rows}
    by_print = {op.fingerprint(t).hex(): t or "" for _, t in rows}
    assert all(r[2] in halves[by_print[r[3]]] for r in got)
    assert {r[7] for r in got if r[3] == op.fingerprint("q r s").hex()} == {7}


def test_one_row_follows_itself_and_none_gives_none(spark):
    one = [(1, "a b c d e f")]
    assert rows_of(op.fingerprints_of_documents(spark.createDataFrame(one, "doc_id long, text string"))) == expected(one)
    assert op.fingerprints_of_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classes_are_those_of_jaccard(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(900)])
    texts = []
    for _ in range(25):
        base = rng.choice(words, 120)
        for changed in (0, 0, 1, 2, 5, 9):
            copy = base.copy()
            copy[rng.choice(120, changed, replace=False)] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, " "]
    sets = [frozenset(op.hashes(op.words_of(t or "")).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in op.fingerprints_of_documents(docs).collect()} == {k: find(k) for k in range(len(texts))}


def test_likeness_estimates_jaccard():
    words = [f"w{k}" for k in range(2000)]
    a, b = op.hashes([w.encode() for w in words]), op.hashes([w.encode() for w in words[500:] + words[:200]])
    sets = set(a.tolist()), set(b.tolist())
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(op.likeness(op.packed(op.minima(a)), op.packed(op.minima(b))) - true) < 0.13
