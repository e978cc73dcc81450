"""Choosing what to study next: bandits, prerequisites, schedules, paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHAIN_MODES, CONFIG
from ..functions.rules import clamp, content_type, review_priority
from .ordered import carried_last


def eligible(concepts: DataFrame, mastery: DataFrame, minutes_left: int) -> DataFrame:
    """Learner and concept pairs that are not mastered yet and fit into the time left; unseen counts as 0."""
    fit = concepts.filter(F.col("time_estimate") <= minutes_left).select(F.col("concept_id").cast("long").alias("concept_id"), "difficulty")
    level = mastery.select("learner_id", F.col("concept_id").cast("long").alias("concept_id"), "level")
    return level.join(fit, "concept_id").filter(F.col("level") < CONFIG.mastered)


def recommend_resources(steps: DataFrame) -> DataFrame:
    """Three resources of each step (learner_id, concept_id, name, difficulty, style) of a path, ranked by the learner's style."""
    style = F.coalesce("style", F.lit("VISUAL"))
    of = lambda kind, priority, text: F.struct(F.lit(kind).alias("kind"), priority.alias("priority"), F.concat(F.lit(text), F.col("name")).alias("description"))
    listed = F.array(
        of("VIDEO", F.when(style == "VISUAL", 1).otherwise(2), "Video tutorial on "), of("EXERCISE", F.lit(1), "Practice exercises for "), of("ARTICLE", F.when(style == "READING", 2).otherwise(3), "Detailed article on ")
    )
    return steps.select("learner_id", "concept_id", content_type(F.col("difficulty"), style).alias("primary_type"), F.explode(listed).alias("r")).select("learner_id", "concept_id", "primary_type", "r.*")


def ucb_select(stats: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate concept of each learner with the best upper confidence bound; untried ones first, ties by id."""
    t = stats.agg((F.sum("pulls") + 1).alias("t"))
    rows = candidates.select("learner_id", "concept_id").join(stats, "concept_id", "left").join(F.broadcast(t))  # one row
    bound = F.when(F.coalesce("pulls", F.lit(0)) == 0, float("inf")).otherwise(F.col("avg_reward") + F.sqrt(2 * F.log("t") / F.col("pulls")))
    rows = rows.withColumn("bound", bound)
    return rows.groupBy("learner_id").agg(F.max_by(F.struct("concept_id", "bound"), F.struct("bound", -F.col("concept_id"))).alias("x")).select("learner_id", "x.*")


def greedy_select(candidates: DataFrame) -> DataFrame:
    """The candidate with the most to gain at a middling difficulty."""
    gain = (1 - F.col("level")) * (1 - F.abs(F.col("difficulty") / 5.0 - 0.5))
    rows = candidates.withColumn("gain", gain)
    return rows.groupBy("learner_id").agg(F.max_by(F.struct("concept_id", "gain"), F.struct("gain", -F.col("concept_id"))).alias("x")).select("learner_id", "x.*")


def linucb_select(arms: DataFrame, learners: DataFrame, dims: int, alpha: float = 1.0, most_arms: int = 20_000) -> DataFrame:
    """The arm of each learner (learner_id, x array) with the best theta' x + alpha sqrt(x' inv(A) x).

    Arms are concepts: their cells reach the driver behind a check of their number, and every task
    inverts each matrix once.
    """
    n = arms.select("concept_id").distinct().count()
    if n > most_arms:
        raise ValueError(f"{n} arms; at most {most_arms} are broadcast, choose candidates by a join first")
    cells = arms.toPandas()
    ids = np.sort(cells["concept_id"].unique())
    at = np.searchsorted(ids, cells["concept_id"].to_numpy())
    a, b = np.tile(np.eye(dims), (n, 1, 1)), np.zeros((n, dims))
    square = (cells["col"] >= 0).to_numpy()
    row, col, v = cells["row"].to_numpy(), cells["col"].to_numpy(), cells["v"].to_numpy()
    a[at[square], row[square], col[square]] = v[square]
    b[at[~square], row[~square]] = v[~square]
    inverse = np.linalg.inv(a)
    shared = learners.sparkSession.sparkContext.broadcast((ids, inverse, np.einsum("nij,nj->ni", inverse, b)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, inverse, theta = shared.value
        for batch in batches:
            x = np.array(batch["x"].tolist()).reshape(-1, dims)
            score = x @ theta.T + alpha * np.sqrt(np.maximum(0, np.einsum("li,nij,lj->ln", x, inverse, x)))
            best = score.argmax(1)
            yield pd.DataFrame({"learner_id": batch["learner_id"], "concept_id": ids[best], "bound": score[np.arange(len(x)), best]})

    return learners.select("learner_id", "x").mapInPandas(run, "learner_id long, concept_id long, bound double")


def review_queue(mastery: DataFrame, n: int = 10) -> DataFrame:
    """The concepts of each learner that are known and about to be forgotten, most urgent first."""
    rows = mastery.filter("level > 0.5").withColumn("priority", F.round(review_priority(F.col("level")), 9))
    order = Window.partitionBy("learner_id").orderBy(F.desc("priority"), "concept_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("learner_id", "concept_id", "priority", "rank")


def review_notes(notes: DataFrame, mastery: DataFrame, below: float = 0.6) -> DataFrame:
    return notes.join(mastery.filter(F.col("level") < below), ["learner_id", "concept_id"]).select("learner_id", "note_id", "concept_id", "level")


def missing_prerequisites(targets: DataFrame, edges: DataFrame, mastery: DataFrame) -> DataFrame:
    """Targets (learner_id, concept_id) with how many of their prerequisites the learner has not reached."""
    need = edges.filter("rel_type = 'REQUIRES'").select(F.col("source").alias("concept_id"), F.col("target").alias("need"))
    passed = mastery.filter(F.col("level") >= CONFIG.prerequisite).select("learner_id", F.col("concept_id").cast("long").alias("need"))
    return targets.join(need, "concept_id").join(passed, ["learner_id", "need"], "left_anti").groupBy("learner_id", "concept_id").agg(F.count(F.lit(1)).alias("missing"))


def prerequisites_met(targets: DataFrame, edges: DataFrame, mastery: DataFrame) -> DataFrame:
    return targets.join(missing_prerequisites(targets, edges, mastery), ["learner_id", "concept_id"], "left_anti")


def chain_mode(decision: Column, key: Column) -> Column:
    """What to look for after a decision; one in ten fresh starts, by a hash of the key, is a review."""
    return (
        F.when(decision == "MASTERED", "ACCELERATE").when(decision == "PROCEED", "FORWARD").when(decision == "ALTERNATE", "LATERAL").when(decision == "REMEDIATE", "BACKWARD").when(decision == "RETRY", "LATERAL")
        .when(F.pmod(key * 7919, F.lit(10)) == 0, "REVIEW").otherwise("FORWARD")
    )


def chain_candidates(at: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Neighbours of (learner_id, concept_id, mode) over the mode's relations, without what was visited."""
    spark = at.sparkSession
    kinds = F.broadcast(spark.createDataFrame([(m, r) for m, rs in CHAIN_MODES.items() for r in rs], "mode string, rel_type string"))
    found = at.join(kinds, "mode").join(edges.select(F.col("source").alias("concept_id"), "target", "rel_type"), ["concept_id", "rel_type"])
    seen = visited.select("learner_id", F.col("concept_id").cast("long").alias("target"))
    return found.select("learner_id", "target").distinct().join(seen, ["learner_id", "target"], "left_anti")


def accelerate(at: DataFrame, edges: DataFrame) -> DataFrame:
    """One and two NEXT steps, and sub-concepts."""
    nxt = edges.filter("rel_type = 'NEXT'").select("source", "target")
    one = at.join(nxt, F.col("concept_id") == F.col("source")).select("learner_id", "target", F.lit(1).alias("steps"))
    two = one.join(nxt.select(F.col("source").alias("target"), F.col("target").alias("t2")), "target").select("learner_id", F.col("t2").alias("target"), F.lit(2).alias("steps"))
    sub = at.join(edges.filter("rel_type = 'IS_SUB_CONCEPT_OF'").select("source", "target"), F.col("concept_id") == F.col("source")).select("learner_id", "target", F.lit(1).alias("steps"))
    return one.unionAll(two).unionAll(sub).groupBy("learner_id", "target").agg(F.min("steps").alias("steps"))


def schedule(steps: DataFrame, hours_per_day: float, budget: float) -> DataFrame:
    """Days of ordered steps (learner_id, pos, hours), as long as the hours before a step are under 80 % of the budget."""
    before = F.coalesce(F.round(F.sum("hours").over(Window.partitionBy("learner_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), 6), F.lit(0.0))
    rows = steps.withColumn("before", before).filter(F.col("before") < round(0.8 * budget, 6))
    return rows.select("learner_id", "pos", "hours", (F.floor(F.col("before") / hours_per_day) + 1).alias("day"))


def success_probability(steps: DataFrame, hours_available: float) -> DataFrame:
    """Chance to complete a path of steps (learner_id, level, hours, difficulty)."""
    out = steps.groupBy("learner_id").agg(F.avg("level").alias("m"), F.sum("hours").alias("h"), F.avg("difficulty").alias("d"))
    fit = F.when(F.col("h") > 0, F.least(F.lit(1.0), hours_available / F.col("h"))).otherwise(1.0)
    penalty = F.greatest(F.lit(0.0), (F.col("d") - 3.0) * 0.1)
    return out.select("learner_id", clamp(CONFIG.success_mastery * F.col("m") + CONFIG.success_time * fit - CONFIG.success_difficulty * penalty).alias("probability"))


def beam_search(starts: DataFrame, edges: DataFrame, mastery: DataFrame, concepts: DataFrame, hours_available: float = 20.0, width: int = 3, depth: int = 3) -> DataFrame:
    """Paths over NEXT and SIMILAR_TO edges, the best `width` of each learner at every depth: learner_id, path, score.

    A path scores 0 if a prerequisite of its last concept is not mastered, or if it has no way on; else the chance to
    complete it (`success_probability`) from the sums that it carries: mastery, hours and difficulty of its steps.
    """
    step = edges.filter("rel_type in ('NEXT', 'SIMILAR_TO')").select(F.col("source").alias("last"), F.col("target").alias("to")).distinct()
    step = step.join(concepts.select(F.col("concept_id").alias("to"), (F.col("time_estimate") / 60.0).alias("hours"), "difficulty"), "to")
    level = mastery.select("learner_id", F.col("concept_id").cast("long").alias("to"), "level")
    need = edges.filter("rel_type = 'REQUIRES'").select(F.col("source").alias("to"), F.col("target").alias("needed")).distinct()
    need = need.join(concepts.select(F.col("concept_id").alias("needed")), "needed")
    known = mastery.filter(F.col("level") >= CONFIG.prerequisite).select("learner_id", F.col("concept_id").cast("long").alias("needed"))
    met = known.join(need, "needed").groupBy("learner_id", "to").agg(F.count(F.lit(1)).alias("met"))
    needs = need.groupBy("to").agg(F.count(F.lit(1)).alias("needs"))
    first = starts.join(concepts.select("concept_id", (F.col("time_estimate") / 60.0).alias("h"), F.col("difficulty").cast("double").alias("d")), "concept_id")
    first = first.join(level.withColumnRenamed("to", "concept_id"), ["learner_id", "concept_id"], "left")
    paths = first.select("learner_id", F.col("concept_id").alias("last"), F.array("concept_id").alias("path"), F.coalesce("level", F.lit(0.0)).alias("m"), "h", "d", F.lit(0.0).alias("score"))
    best = Window.partitionBy("learner_id").orderBy(F.desc(F.round("score", 9)), "path")
    for _ in range(depth - 1):
        longer = paths.join(step, "last", "left").filter(F.col("to").isNull() | ~F.array_contains("path", F.col("to")))
        longer = longer.join(level, ["learner_id", "to"], "left").join(needs, "to", "left").join(met, ["learner_id", "to"], "left")
        on = F.col("to").isNotNull()
        plus = lambda a, b: F.when(on, F.col(a) + F.coalesce(b, F.lit(0.0))).otherwise(F.col(a))  # noqa: B023, E731
        longer = longer.select(
            "learner_id", F.coalesce("to", "last").alias("last"), F.when(on, F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"),
            plus("m", "level").alias("m"), plus("h", "hours").alias("h"), plus("d", "difficulty").alias("d"), (on & (F.coalesce("met", F.lit(0)) >= F.coalesce("needs", F.lit(0)))).alias("open"),
        )
        n = F.size("path")
        fit = F.when(F.col("h") > 0, F.least(F.lit(1.0), hours_available / F.col("h"))).otherwise(1.0)
        chance = clamp(CONFIG.success_mastery * F.col("m") / n + CONFIG.success_time * fit - CONFIG.success_difficulty * F.greatest(F.lit(0.0), (F.col("d") / n - 3.0) * 0.1))
        longer = longer.withColumn("score", F.when(F.col("open"), chance).otherwise(0.0))
        paths = longer.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= width).drop("rank", "open")
    return paths.select("learner_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("score", 6).alias("score"))


def context_asof(selections: DataFrame, feedback: DataFrame, hours: int = 24) -> DataFrame:
    """Feedback (feedback_id, concept_id, ts) with the newest context saved for its concept in the hours before.

    Of contexts saved at one time the largest counts; a context saved at the time of the feedback counts. One union, sorted by range:
    a concept's rows lie in as many tasks as they fill, the last context of each range is carried over to the next ones
    (`ordered.carried_last`), and no pair of rows is ever formed.
    """
    saved = F.struct("ts", "context")
    rows = selections.select("concept_id", "ts", F.lit(0).alias("kind"), F.col("context").alias("tie"), F.lit(None).cast("long").alias("feedback_id"), saved.alias("saved")).unionByName(
        feedback.select("concept_id", "ts", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("tie"), "feedback_id").withColumn("saved", F.lit(None)), allowMissingColumns=True
    )
    rows = carried_last(rows, ["concept_id"], ["ts", "kind", "tie", "feedback_id"], "saved").filter("kind = 1")
    fresh = F.unix_timestamp("ts") - F.unix_timestamp("last.ts") <= hours * 3600
    return rows.select("feedback_id", F.when(fresh, F.col("last.context")).alias("context"))
