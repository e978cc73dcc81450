"""Statistics of learning experiments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import effect_band, learning_gain, retention_decay
from ..store import small

#: 97.5 % quantiles of Student's t by degrees of freedom; beyond the last the normal value.
T975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980}


def gains(outcomes: DataFrame) -> DataFrame:
    band = F.when(F.col("pre") <= 30, "low").when(F.col("pre") <= 70, "medium").otherwise("high")
    return outcomes.select("learner_id", "cohort", "condition", learning_gain(F.col("pre"), F.col("post")).alias("gain"), retention_decay(F.col("post"), F.col("retention")).alias("decay"), band.alias("band"))


def cohens_d(rows: DataFrame, value: str, treated: Column, keys: list[str] | None = None) -> DataFrame:
    """Effect of treatment on `value` with the pooled deviation, from one pass of sums; per key if any."""
    side = lambda on: F.when(on, F.col(value))
    t, c = side(treated), side(~treated)
    sums = rows.groupBy(*(keys or [])).agg(
        F.avg(t).alias("mean_t"), F.avg(c).alias("mean_c"), F.var_samp(t).alias("var_t"), F.var_samp(c).alias("var_c"), F.count(t).alias("n_t"), F.count(c).alias("n_c")
    )
    pooled = F.sqrt(((F.col("n_t") - 1) * F.coalesce("var_t", F.lit(0.0)) + (F.col("n_c") - 1) * F.coalesce("var_c", F.lit(0.0))) / (F.col("n_t") + F.col("n_c") - 2))
    ok = (F.col("n_t") > 0) & (F.col("n_c") > 0) & (F.col("n_t") + F.col("n_c") > 2)
    out = sums.withColumn("pooled_sd", F.when(ok, pooled))
    d = F.when(F.col("pooled_sd") > 0, (F.col("mean_t") - F.col("mean_c")) / F.col("pooled_sd")).otherwise(0.0)
    label = F.when((F.col("n_t") == 0) | (F.col("n_c") == 0), "no data").when(F.col("n_t") + F.col("n_c") <= 2, "insufficient sample").when(F.col("pooled_sd") == 0, "no variance")
    return out.withColumn("cohens_d", d).withColumn("interpretation", F.coalesce(label, effect_band(F.col("cohens_d")))).drop("var_t", "var_c")


def confidence_interval(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean and 95 % bounds per key; no bounds for fewer than two values."""
    df = F.col("n") - 1
    t = F.lit(1.96)
    for k in sorted(T975, reverse=True):
        t = F.when(df <= k, T975[k]).otherwise(t)
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") >= 2, t * F.col("sd") / F.sqrt(F.col("n")))
    return out.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def ablation_table(found: DataFrame, full: int = 0) -> DataFrame:
    """Per condition: mean gain and decay, and the effect of the full system against it."""
    base = found.filter(F.col("condition") == full).agg(F.avg("gain").alias("m0"), F.var_samp("gain").alias("v0"), F.count(F.lit(1)).alias("n0"))
    out = found.groupBy("condition").agg(F.avg("gain").alias("mean_gain"), F.avg("decay").alias("mean_decay"), F.var_samp("gain").alias("v"), F.count(F.lit(1)).alias("n"))
    out = out.join(F.broadcast(base))  # one row
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n") - 1) * F.col("v")) / (F.col("n0") + F.col("n") - 2))
    return out.select("condition", "n", "mean_gain", "mean_decay", F.when(pooled > 0, (F.col("m0") - F.col("mean_gain")) / pooled).otherwise(0.0).alias("d_full"))


def component_contribution(table: DataFrame, baseline: int = 4) -> DataFrame:
    """How much of the effect over the baseline each removed component accounts for."""
    base = table.filter(F.col("condition") == baseline).select(F.col("d_full").alias("d_base"))
    out = table.filter(~F.col("condition").isin(0, baseline)).join(F.broadcast(base))  # one row
    return out.select("condition", F.col("d_full").alias("delta_d"), F.when(F.col("d_base") != 0, 100 * F.col("d_full") / F.col("d_base")).alias("share_pct"))


def bootstrap_ci(rows: DataFrame, value: str, treated: Column, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """Percentile interval (low, median, high) of Cohen's d from a Poisson bootstrap.

    Rows of a side with equal values are one row of n, whose weight in a resample is one Poisson(n) draw, as the sum of n Poisson(1)
    draws is. Each value draws its weights in all resamples from a generator seeded by itself, so the result depends on neither order
    nor partitions; a task adds up the moments of its values and passes on two rows for each resample. Rows with a null value or
    side don't count; resamples in which a side is empty or nothing varies have no effect size and are left out.
    """
    counted = rows.select(F.col(value).cast("double").alias("x"), treated.cast("boolean").alias("t")).dropna().groupBy("x", "t").agg(F.count(F.lit(1)).alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 3, resamples))
        for batch in batches:
            for x, t, n in zip(batch["x"].tolist(), batch["t"].tolist(), batch["n"].tolist(), strict=True):
                key = int(np.float64(x + 0.0).view(np.uint64))
                w = np.random.default_rng([seed, int(t), key]).poisson(n, resamples)
                sums[int(t)] += w * np.array([[1.0], [x], [x * x]])
        for t in (0, 1):
            if sums[t].any():
                yield pd.DataFrame({"b": np.arange(resamples), "t": t, "n": sums[t, 0], "s": sums[t, 1], "q": sums[t, 2]})

    m = counted.mapInPandas(draw, "b int, t int, n double, s double, q double").groupBy("b", "t").agg(*[F.sum(c).alias(c) for c in "nsq"])
    of = lambda side, c: F.max(F.when(F.col("t") == side, F.col(c)))
    m = m.groupBy("b").agg(*[of(side, c).alias(f"{c}{side}") for side in (1, 0) for c in "nsq"]).filter("n1 > 0 and n0 > 0 and n1 + n0 > 2")
    ss = lambda k: F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}")
    spread = F.sqrt(F.greatest(ss(1) + ss(0), F.lit(0.0)) / (F.col("n1") + F.col("n0") - 2))
    d = F.when(spread > 0, (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")) / spread)
    return m.select(d.alias("d")).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.5)).alias("median"), F.percentile("d", F.lit(0.975)).alias("high"))


def time_to_mastery(attempts: DataFrame, level: float = 0.7) -> DataFrame:
    """The first attempt of each learner at which the running mean score reaches `level`."""
    order = Window.partitionBy("learner_id").orderBy("ts", "attempt_id")
    rows = attempts.select("learner_id", F.row_number().over(order).alias("n"), F.avg("score").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("mean"))
    return rows.filter(F.col("mean") >= level).groupBy("learner_id").agg(F.min("n").alias("attempts_needed"))


def retention_rate(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("condition").agg((100 * F.avg("retention") / F.avg("post")).alias("retention_pct"))


def engagement(attempts: DataFrame) -> DataFrame:
    per = attempts.groupBy("learner_id").agg(F.countDistinct("concept_id").alias("c"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg((F.col("c") >= 15).cast("double")).alias("completion_rate"), F.avg((F.col("n") < 60).cast("double")).alias("dropout_rate"))


def assign(learners: DataFrame, salt: int = 2654435761) -> DataFrame:
    """A cohort for each learner from an arithmetic hash of the id."""
    h = F.pmod(F.col("learner_id") * F.lit(salt), F.lit(1 << 32))
    return learners.select("learner_id", F.when(F.floor(h / 65536) % 2 == 0, "treatment").otherwise("control").alias("cohort"))


def exposure(assigned: DataFrame, log: DataFrame) -> DataFrame:
    """Intent-to-treat against as-treated means: log (learner_id, ts, shown, outcome), assigned (learner_id, cohort)."""
    first = log.groupBy("learner_id").agg(F.min_by("shown", F.struct("ts", "shown")).alias("shown"), F.avg("outcome").alias("outcome"))
    rows = assigned.join(first, "learner_id", "left")
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("assigned"), F.avg("outcome").alias("itt"), F.avg(F.when(F.col("shown") == F.col("cohort"), F.col("outcome"))).alias("as_treated"))


def weight_sweep(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean and deviation of a weighted quality under each weight vector (a handful, given by the caller)."""
    rows = scores.join(small(weights, 1000, "weight vectors"))
    q = F.col("w1") * F.col("feasibility") + F.col("w2") * F.col("coherence") + F.col("w3") * F.col("relevance")
    return rows.groupBy("vector").agg(F.avg(q).alias("mean_quality"), F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("sd_quality"))


def weight_ablation(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(metric, delta_score, percentage_change): what the mean weighted score loses without each of its weights.

    A weight goes to zero and the others are scaled up to a sum of one. The score is linear, so one pass takes the means.
    """
    total = sum(weights.values())
    means = scores.agg(*[F.avg(c).alias(c) for c in weights])
    score = lambda some: sum(F.col(c) * w for c, w in some.items()) / sum(some.values())
    full = score(weights) * total
    rows = [F.struct(F.lit(c).alias("metric"), (score({k: w for k, w in weights.items() if k != c}) - full).alias("delta_score"), full.alias("full")) for c in weights]
    out = means.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return out.select("metric", "delta_score", F.when(F.col("full") != 0, 100 * F.col("delta_score") / F.col("full")).otherwise(0.0).alias("percentage_change"))
