"""The divergence of sources and the prefix trie against DuckDB, on tables with nulls, ties, repeats and a hot group."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from scholarflow.llm import op12_sources, op13_prefixes

TERMS = ["Alpha", "alpha", "béta", "ΓΆΜΜΑ", "delta", "epsilon", "zeta", "x1y", "naïve", "don't"]


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def expected(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(str(tuple(r[k] for k in at)) for r in cur.fetchall())


@pytest.mark.parametrize("blocks", [False, True])
def test_divergence_equals_sql(spark, monkeypatch, blocks):
    if blocks:
        for name, value in (("BLOCK", 2), ("TERMS", 3), ("HELD", 5)):
            monkeypatch.setattr(op12_sources, name, value)
    rng = np.random.default_rng(2)
    docs = [(" ".join(rng.choice(TERMS, rng.integers(0, 12), p=np.arange(1, 11) / 55)), str(rng.choice(["en", "fr"])), f"s{rng.integers(0, 5)}") for _ in range(120)]
    docs += [("alpha beta same text", "en", s) for s in ["s1"] * 60 + ["s2", None, "s1"]]
    docs += [(None, "en", "s9"), ("", None, None), (None, None, "s1"), ("lonely words", "de", "only"), ("x " * 5000 + "end", "fr", "s1")]
    frame = pd.DataFrame(docs, columns=["text", "lang", "source"])
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "text string, lang string, source string, key int, n int")
    got = rows_of(op12_sources.source_divergence(df.repartition(3), least=8))
    assert got == expected(op12_sources.SQL.replace(">= 30", ">= 8"), documents=frame)


def test_divergence_of_nothing(spark):
    assert op12_sources.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def conversations(seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 60, 1), 75, 76, 103, 1000]:
        if c in (10, 35):  # blocks without a first conversation
            continue
        for t in range(int(rng.integers(1, 12)) if c != 21 else 70):
            rows.append((c, t, str(rng.choice(["user", "bot"])) if rng.random() > 0.05 else None, str(rng.choice(["hi", "ja", "né", ""])) if rng.random() > 0.05 else None))
    rows += [(c, t, "user", "copy") for c in range(200, 260) for t in range(2)]  # many of one kind
    rows += [(7, None, "user", "first of all"), (7, None, "a", "before it"), (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    return rows


def test_trie_equals_sql(spark):
    rows = conversations()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    df = spark.createDataFrame([(*r, 1, "x") for r in [*rows, (None, 1, "user", "no conversation")]], "conv_id long, turn long, role string, text string, d int, name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that conversations lie in several ranges
    try:
        got = rows_of(op13_prefixes.rebuilt_trie(df.repartition(3)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(op13_prefixes.SQL, conversations=frame)


def test_trie_of_nothing(spark):
    assert op13_prefixes.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_lists_of_ids_are_hashed_in_pieces(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(op13_prefixes, "PIECE", 7)
    ends = spark.createDataFrame([(1, b"a", k) for k in range(100)] + [(1, b"b", 5)], "d long, name binary, conv_id long").repartition(5)
    got = {bytes(r["name"]): r["ends_sha256"] for r in op13_prefixes._hashed_ids(ends).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest(), b"b": hashlib.sha256(b"5").hexdigest()}
