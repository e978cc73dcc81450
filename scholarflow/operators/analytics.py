"""Cohort and concept analytics. One grouped aggregation each; partial sums are taken before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..store import small
from .ordered import running_sum


def concept_stats(mastery: DataFrame) -> DataFrame:
    """Per concept: learners, mean, sample deviation (0 for one), extremes and the share that struggles."""
    return mastery.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("level").alias("avg_mastery"), F.coalesce(F.stddev_samp("level"), F.lit(0.0)).alias("std_mastery"),
        F.min("level").alias("min_mastery"), F.max("level").alias("max_mastery"), F.avg((F.col("level") < CONFIG.struggle_below).cast("double")).alias("struggle_rate"),
    )


def enough_learners(mastery: DataFrame, stats: DataFrame) -> DataFrame:
    """`stats`, or nothing if fewer than the least number of learners are known."""
    gate = mastery.agg(F.countDistinct("learner_id").alias("learners")).filter(F.col("learners") >= CONFIG.min_learners)
    return stats.join(F.broadcast(gate))  # one row at most


def bottlenecks(stats: DataFrame) -> DataFrame:
    """Difficult and easy concepts with a line of insight."""
    kind = F.when(F.col("avg_mastery") < CONFIG.difficult_below, "difficult").when(F.col("avg_mastery") > CONFIG.easy_above, "easy")
    text = F.format_string("Concept %d is %s: %d learners", F.col("concept_id"), F.col("kind"), F.col("n"))
    return stats.withColumn("kind", kind).filter("kind is not null").select("concept_id", "kind", "avg_mastery", "struggle_rate", text.alias("insight"))


def recommendations(found: DataFrame) -> DataFrame:
    """Three rows for a difficult concept with much struggle, one with some."""
    rows = F.when(F.col("struggle_rate") > CONFIG.priority_struggle, F.array(*map(F.lit, ("add_examples", "add_exercises", "review_prerequisites")))).when(
        F.col("struggle_rate") > CONFIG.moderate_struggle, F.array(F.lit("add_exercises"))
    )
    return found.filter("kind = 'difficult'").select("concept_id", F.explode(rows).alias("action"))


def interventions(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'difficult'").select("concept_id", F.explode(F.array(F.lit("early_tutoring"), F.lit("extra_time"))).alias("intervention"))


def prerequisite_impact(found: DataFrame, edges: DataFrame, mastery: DataFrame) -> DataFrame:
    """For each difficult concept, the mean mastery of each of its prerequisites over all learners."""
    hard = found.filter("kind = 'difficult'").select(F.col("concept_id").cast("long").alias("source"))
    needed = edges.filter("rel_type = 'REQUIRES'").select("source", "target").join(hard, "source", "left_semi")
    level = mastery.groupBy(F.col("concept_id").cast("long").alias("target")).agg(F.avg("level").alias("prerequisite_mastery"), F.count(F.lit(1)).alias("learners"))
    return needed.join(level, "target").select(F.col("source").alias("concept_id"), F.col("target").alias("prerequisite"), "prerequisite_mastery", "learners")


def learner_graphs(mastery: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("concept_id", "level")))
    return mastery.groupBy("learner_id").agg(F.count(F.lit(1)).alias("n_concepts"), F.array_join(F.transform(pairs, lambda x: x["concept_id"].cast("string")), ",").alias("concepts"))


def avg_mastery(mastery: DataFrame) -> DataFrame:
    return mastery.groupBy("learner_id").agg(F.avg("level").alias("avg_mastery"))


def run_summary(runs: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return runs.agg(F.count(F.lit(1)).alias("runs"), (100 * F.avg(ok.cast("double"))).alias("success_pct"), F.avg(F.when(ok & (F.col("mode") == "real"), F.col("duration"))).alias("mean_real_duration"))


def run_by_kind_mode(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'success'").groupBy("kind", "mode").agg(F.avg("duration").alias("mean_duration"), F.count(F.lit(1)).alias("runs"))


def run_latency(runs: DataFrame) -> DataFrame:
    return runs.groupBy("kind", "mode").agg(*[(F.avg(f"{c}_ms") / 1000).alias(f"{c}_s") for c in ("ke", "profiler", "tutor")])


def agent_calls(calls: DataFrame) -> DataFrame:
    return calls.groupBy("agent").agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("latency_ms").alias("avg_latency"), F.min("latency_ms").alias("min_latency"), F.max("latency_ms").alias("max_latency")
    )


def agent_health(calls: DataFrame, now: Column) -> DataFrame:
    """Calls and errors of each agent in the day before `now`, and a status."""
    recent = calls.filter((F.col("called_at") > now - F.expr("interval 24 hours")) & (F.col("called_at") <= now))
    out = recent.groupBy("agent").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col("success"), 1)).alias("errors"), F.avg("latency_ms").alias("latency"))
    return out.withColumn("status", F.when(F.col("errors") * 2 > F.col("calls"), "down").when(F.col("errors") > 0, "degraded").otherwise("healthy"))


def cohort_compare(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("post").alias("avg_post"), F.avg((F.col("post") >= 50).cast("double")).alias("completion_rate"))


def roster(attempts: DataFrame, now: Column) -> DataFrame:
    out = attempts.groupBy("learner_id").agg(F.max("ts").alias("last_active"), F.countDistinct("concept_id").alias("concepts"), F.avg("score").alias("progress"))
    return out.withColumn("status", F.when(F.col("last_active") >= now - F.expr("interval 7 days"), "active").otherwise("inactive"))


def system_totals(mastery: DataFrame, stats: DataFrame) -> DataFrame:
    totals = mastery.agg(F.countDistinct("learner_id").alias("learners"), F.countDistinct("concept_id").alias("concepts"), F.avg("level").alias("avg_success"))
    lists = stats.agg(F.count(F.when(F.col("avg_mastery") < CONFIG.difficult_below, 1)).alias("difficult"), F.count(F.when(F.col("avg_mastery") > CONFIG.easy_above, 1)).alias("easy"))
    return totals.join(F.broadcast(lists))  # one row each


def error_patterns(attempts: DataFrame) -> DataFrame:
    """Per learner, concept and error type: how often, when last, and its latest severity."""
    severity = F.when(F.col("score") < 0.2, "HIGH").when(F.col("score") < 0.5, "MEDIUM").otherwise("LOW")
    return attempts.groupBy("learner_id", "concept_id", "err").agg(
        F.count(F.lit(1)).alias("frequency"), F.max("ts").alias("last_seen"), F.max_by(severity, F.struct("ts", "attempt_id")).alias("severity")
    )


def misconception_flags(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("learner_id", "concept_id").agg(
        F.bool_or(F.col("severity") == "HIGH").alias("severe"), F.bool_or(F.col("err") == "CONCEPTUAL").alias("conceptual"), F.bool_or(F.col("frequency") >= 3).alias("persistent")
    )


def error_distribution(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("learner_id").pivot("err", ["CARELESS", "CONCEPTUAL", "INCOMPLETE"]).count().na.fill(0)


def bandit_stats(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("concept_id").agg(F.count(F.lit(1)).alias("pulls"), F.sum("score").alias("total_reward"), F.avg("score").alias("avg_reward"))


def linucb_arms(attempts: DataFrame, features: list[Column]) -> DataFrame:
    """Cells of A = I + sum x x' and b = sum r x of every concept, one row per cell (col -1 holds b)."""
    d = len(features)
    cells = [F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), (features[i] * features[j]).alias("v")) for i in range(d) for j in range(d)]
    cells += [F.struct(F.lit(i).alias("row"), F.lit(-1).alias("col"), (F.col("score") * features[i]).alias("v")) for i in range(d)]
    rows = attempts.select("concept_id", F.explode(F.array(*cells)).alias("c")).select("concept_id", "c.*")
    return rows.groupBy("concept_id", "row", "col").agg((F.sum("v") + F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0)).alias("v"))


def weighted_merge(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted mean of `value` per key; the plain mean where all weights are 0."""
    total = F.sum(weight)
    return rows.groupBy(key).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value)).alias("merged"))


def representative(rows: DataFrame, key: str) -> DataFrame:
    """Per cluster: the concept with the longest description (then the smallest id), and all tags."""
    best = F.max_by("concept_id", F.struct(F.length("description"), -F.col("concept_id")))
    return rows.groupBy(key).agg(best.alias("representative"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("tags"), F.count(F.lit(1)).alias("members"))


def context_pending(usages: DataFrame, now: Column) -> DataFrame:
    """Raw contexts (domain, context, doc_id, ts) that wait for review: how often, lately, and in how many documents."""
    recent = F.count(F.when(F.col("ts") >= now - F.expr("interval 7 days"), 1))
    out = usages.groupBy("domain", "context").agg(F.count(F.lit(1)).alias("total"), recent.alias("recent"), F.countDistinct("doc_id").alias("docs"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.withColumn("needs_review", (F.col("recent") >= 5) | ((F.col("recent") >= 2) & (F.col("docs") >= 2)))


def top_per_group(counts: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= limit)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    size = F.length("text")
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("words"), F.sum(size).alias("chars"), F.avg(size).alias("avg_chars"), F.min(size).alias("min_chars"), F.max(size).alias("max_chars")
    )


def remediation(errors: DataFrame) -> DataFrame:
    """Error episodes (severity, remediated, success, hours): shares and mean time by severity."""
    return errors.groupBy("severity").agg(
        F.count(F.lit(1)).alias("errors"), F.avg(F.col("remediated").cast("double")).alias("remediated_share"), F.avg(F.when(F.col("remediated"), F.col("success").cast("double"))).alias("success_share"), F.avg("hours").alias("mean_hours")
    )


def note_quality(notes: DataFrame) -> DataFrame:
    per = notes.groupBy("learner_id", "concept_id").agg(F.count(F.lit(1)).alias("notes"))
    return per.groupBy("learner_id").agg(F.count(F.lit(1)).alias("concepts"), F.avg("notes").alias("notes_per_concept"))


def artifact_state(notes: DataFrame) -> DataFrame:
    words = F.size(F.split("content", " "))
    kinds = ["ATOMIC_NOTE", "MISCONCEPTION_NOTE", "SUMMARY_NOTE"]
    return notes.groupBy("learner_id").agg(*[F.count(F.when(F.col("note_type") == k, 1)).alias(k.lower()) for k in kinds], F.sum(words).alias("words"), F.max("created_at").alias("last_created"))


def strata_rollup(gains: DataFrame) -> DataFrame:
    """Mean gain by prior band and condition, with subtotals and the total."""
    return gains.cube("band", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg("gain").alias("mean_gain"))


def grade_tests(answers: DataFrame) -> DataFrame:
    """Answers (learner_id, answer, correct_answer, points): points won and the score of each learner."""
    won = F.sum(F.when(F.col("answer") == F.col("correct_answer"), F.col("points")).otherwise(0))
    return answers.groupBy("learner_id").agg(won.alias("points"), (won / F.sum("points")).alias("score"))


def rubric_score(levels: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of criterion levels, and its band; the rubric (a table of criteria) is a lookup side of a few rows."""
    score = levels.join(small(weights, 1000, "criteria"), "criterion").groupBy("learner_id").agg(F.sum(F.col("weight") * F.col("level")).alias("score"))
    return score.withColumn("band", F.when(F.col("score") >= 0.8, "excellent").when(F.col("score") >= 0.6, "good").when(F.col("score") >= 0.4, "fair").otherwise("poor"))


def fractional_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, `value` and `rank` for each distinct value of a key: the place of its rows in ascending order, ties averaged.

    Equal values are counted before anything is ordered, and the counts are summed over ranges of the order (`ordered.running_sum`),
    so a key with most of the rows, or a value with most of them, is in no single task. A null value comes first.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, keys, [value], "n").select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def grader_quality(grades: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman correlation of grades with reference grades, and of grades with answer length (grade, reference, length).

    Rows with the same three values are one row with a weight, to which the ranks are joined.
    """
    columns = ["grade", "reference", "length"]
    rows = grades.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("w"))
    for c in columns:
        ranks = fractional_ranks(grades, keys, c).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(c).alias("_value"), F.col("rank").alias(f"r_{c}"))
        same = F.col(c).eqNullSafe(F.col("_value"))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(ranks, same, "left").drop("_value", *[f"_{k}" for k in keys])
    total = lambda x: F.sum(F.col("w") * x)

    def weighted(a: str, b: str) -> Column:
        """Correlation of ranks, which have the mean (n + 1) / 2 whatever the ties."""
        mean = (F.sum("w") + 1) / 2
        part = lambda x, y: total(F.col(x) * F.col(y)) - F.sum("w") * mean * mean
        spread = F.sqrt(part(a, a) * part(b, b))
        return F.when(spread > 0, part(a, b) / spread)

    rho = rows.groupBy(*keys).agg(weighted("r_grade", "r_reference").alias("rho"), weighted("r_grade", "r_length").alias("length_bias"))
    spread = grades.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.stddev_samp("grade").alias("spread"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rho.join(spread, same).select(*rho.columns, "spread")
