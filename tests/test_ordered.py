"""Work on ordered keys against plain loops, with one key that holds nearly all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarflow.operators import mastery, ordered, planning


def made(n, hot=0.7, keys=5, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < hot, 0, rng.integers(1, keys, n))
    return [(int(k), 1, int(t), i, float(s), str(b)) for i, (k, t, s, b) in enumerate(zip(key, rng.integers(0, n, n), rng.choice([0.0, 0.2, 0.5, 0.7, 0.95, 1.0], n), rng.choice(["APPLY", "CREATE", "REMEMBER"], n), strict=True))]


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in several ranges, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


SCHEMA = "learner_id long, concept_id int, ts long, attempt_id long, score double, bloom string"


def looped(rows):
    out = {}
    for learner, concept, _, _, s, b in sorted(rows, key=lambda r: r[2:4]):
        m, p, n = out.get((learner, concept), (0.0, 0.3, 0))
        step = 0.05 if s >= 0.9 and b in ("UNDERSTAND", "APPLY", "ANALYZE") else -0.05 if s < 0.4 and b in ("ANALYZE", "EVALUATE", "CREATE") else 0.0
        seen = p * 0.9 / (p * 0.9 + (1 - p) * 0.25) if s >= 0.6 else p * 0.1 / (p * 0.1 + (1 - p) * 0.75)
        out[learner, concept] = min(1.0, max(0.0, m * 0.7 + s * 0.3 + step)), seen + (1 - seen) * 0.1, n + 1
    return out


def test_folds_equal_loops(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_BITS", 2)
    rows = made(1500)
    df, want = spark.createDataFrame(rows, SCHEMA).repartition(5), looped(rows)
    got = {(r["learner_id"], r["concept_id"]): (r["mastery"], r["attempts"]) for r in mastery.ewma(df).collect()}
    known = {(r["learner_id"], r["concept_id"]): r["p_known"] for r in mastery.bkt(df).collect()}
    assert got.keys() == known.keys() == want.keys()
    for k, (m, p, n) in want.items():
        assert got[k][1] == n and abs(got[k][0] - m) < 1e-12 and abs(known[k] - p) < 1e-12


def test_a_pair_with_a_million_attempts_is_in_no_single_row(spark):
    n = 1_000_000
    score = F.pmod(F.xxhash64("id"), F.lit(101)) / 100.0
    df = spark.range(n).select(F.lit(1).cast("long").alias("learner_id"), F.lit(2).alias("concept_id"), F.col("id").alias("ts"), F.col("id").alias("attempt_id"), score.alias("score"), F.when(F.col("id") % 2 == 0, "APPLY").otherwise("CREATE").alias("bloom"))
    last = looped([tuple(r) for r in df.filter(F.col("ts") >= n - 200).select("learner_id", "concept_id", "ts", "attempt_id", "score", "bloom").collect()])
    r = mastery.ewma(df).first()
    assert r["attempts"] == n and abs(r["mastery"] - last[1, 2][0]) < 1e-9  # 0.7 ** 200 of what came before
    longest = ordered.fold(df, ["learner_id"], ["ts"], F.array(F.lit(1)), lambda f, g: F.array(F.greatest(f[0], g[0]))).first()
    assert longest["n"] == n and longest["composed"] == [1]


def test_empty_tables_give_none(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mastery.ewma(df).count() == 0 and mastery.bkt(df).count() == 0


def test_dialogues_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_BITS", 1)
    rng = np.random.default_rng(4)
    turns = [(c, t, bool(rng.random() < 0.5)) for c in range(30) for t in range(int(rng.integers(1, 25)))]
    state = {}
    for c, _, ok in sorted(turns):
        state[c] = mastery.tutored(state.get(c, (0, 0, 0)), ok)
    got = {r["conv_id"]: r["phase"] for r in mastery.dialogue_phases(spark.createDataFrame(turns, "conv_id long, turn long, is_correct boolean")).collect()}
    assert got == {c: ("EXPLANATION", "QUESTIONING", "PRACTICE", "ASSESSMENT")[s[0]] for c, s in state.items()}


@pytest.mark.parametrize("hot", [0.1, 0.95])
def test_running_sums_and_carried_values(spark, hot):
    rng = np.random.default_rng(7)
    rows = [(None if k == 4 else k, t, None if rng.random() < 0.6 else int(rng.integers(0, 99))) for k, _, t, *_ in made(900, hot)]
    rows = [(k, i, v) for i, (k, _, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(4)
    before, last, want = {}, {}, {}
    for k, t, v in rows:
        last[k] = last.get(k) if v is None else v
        want[t] = before.get(k, 0), last[k]
        before[k] = before.get(k, 0) + (v or 0)
    sums = {r["t"]: r["before"] for r in ordered.running_sum(df, ["k"], ["t"], "v").collect()}
    lasts = {r["t"]: r["last"] for r in ordered.carried_last(df, ["k"], ["t"], "v").collect()}
    assert sums == {t: w[0] for t, w in want.items()} and lasts == {t: w[1] for t, w in want.items()}


def test_a_hot_key_spreads_over_ranges(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    assert ordered.ranged(df, ["k"], ["t"]).groupBy("range").count().count() > 1


def test_asof_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    at = lambda: int(rng.integers(0, 400_000))
    saved = [(int(rng.random() < 0.2), at(), float(i)) for i in range(60)]
    asked = [(int(rng.random() < 0.2), at(), i) for i in range(200)] + [(0, saved[0][1], 900), (7, 5, 901)]
    want = {}
    for c, t, i in asked:
        before = max(((s, x) for k, s, x in saved if k == c and s <= t), default=None)
        want[i] = before[1] if before and t - before[0] <= 86400 else None
    s = spark.createDataFrame(saved, "concept_id int, s long, context double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    f = spark.createDataFrame(asked, "concept_id int, s long, feedback_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert {r["feedback_id"]: r["context"] for r in planning.context_asof(s, f).collect()} == want
