"""Mastery over ordered attempts: folds, trends, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from .ordered import fold

PAIR = ["learner_id", "concept_id"]


def ewma(attempts: DataFrame) -> DataFrame:
    """Moving average of the scores from 0, with a Bloom step up or down, clamped after every attempt.

    An attempt takes mastery x to clamp(a x + b, low, high), and two such steps are one of the same form, so a history
    is composed in parts (`ordered.fold`) and only then applied to 0.
    """
    bloom = (
        F.when((F.col("score") >= 0.9) & F.col("bloom").isin("UNDERSTAND", "APPLY", "ANALYZE"), CONFIG.bloom_step)
        .when((F.col("score") < 0.4) & F.col("bloom").isin("ANALYZE", "EVALUATE", "CREATE"), -CONFIG.bloom_step)
        .otherwise(0.0)
    )
    add = F.col("score") * CONFIG.session_weight + bloom
    step = F.struct(F.lit(CONFIG.history_weight).alias("a"), add.alias("b"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    within = lambda x, s: F.greatest(s["low"], F.least(s["high"], x))

    def compose(f: Column, g: Column) -> Column:
        ends = [within(g["a"] * f[c] + g["b"], g).alias(c) for c in ("low", "high")]
        return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), *ends)

    out = fold(attempts, PAIR, ["ts", "attempt_id"], step, compose)
    return out.select(*PAIR, within(F.col("composed.b"), F.col("composed")).alias("mastery"), F.col("n").cast("int").alias("attempts"))


def bkt(attempts: DataFrame, prior: float = 0.3) -> DataFrame:
    """Bayesian knowledge tracing; an attempt with a score of 0.6 or more counts as right.

    An attempt multiplies the weights (p, 1 - p) of knowing and not knowing by a 2 x 2 matrix, so a history is composed in parts by products
    (`ordered.fold`), each divided by its sum, since only ratios count. No number is negative, so nothing cancels out.
    """

    def matrix(known: float, unknown: float) -> Column:
        # the odds of what was seen, and then a share of those who don't know learns
        return F.struct(*[F.lit(float(x)).alias(n) for n, x in (("a", known), ("b", CONFIG.learn * unknown), ("c", 0), ("d", (1 - CONFIG.learn) * unknown))])

    right, wrong = matrix(1 - CONFIG.slip, CONFIG.guess), matrix(CONFIG.slip, 1 - CONFIG.guess)

    def compose(f: Column, g: Column) -> Column:
        cells = {"a": ("a", "a", "b", "c"), "b": ("a", "b", "b", "d"), "c": ("c", "a", "d", "c"), "d": ("c", "b", "d", "d")}
        m = {n: g[w] * f[x] + g[y] * f[z] for n, (w, x, y, z) in cells.items()}
        size = sum(m.values(), F.lit(0.0))
        return F.struct(*[(m[n] / size).alias(n) for n in "abcd"])

    out = fold(attempts, PAIR, ["ts", "attempt_id"], F.when(F.col("score") >= 0.6, right).otherwise(wrong), compose)
    m = F.col("composed")
    known, unknown = (m[x] * prior + m[y] * (1 - prior) for x, y in ("ab", "cd"))
    return out.select(*PAIR, (known / (known + unknown)).alias("p_known"))


def trend(attempts: DataFrame) -> DataFrame:
    """Attempts, current score, velocity, and a trend from the mean of the last three."""
    order = Window.partitionBy(*PAIR).orderBy("ts", "attempt_id")
    last3 = F.avg("score").over(order.rowsBetween(-2, 0))
    rows = attempts.select(*PAIR, "ts", "attempt_id", "score", last3.alias("recent"))
    at = F.struct("ts", "attempt_id")
    out = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("attempts"), F.min_by("score", at).alias("first"), F.max_by("score", at).alias("current"), F.max_by("recent", at).alias("recent"))
    velocity = F.when(F.col("attempts") >= 2, (F.col("current") - F.col("first")) / F.col("attempts")).otherwise(F.col("current"))
    velocity = F.floor(velocity * 1000 + 0.500001) / 1000  # exact halves go up
    kind = F.when(F.col("attempts") < 3, "INITIAL").when(F.col("recent") >= 0.8, "MASTERING").when(F.col("recent") >= 0.5, "PROGRESSING").otherwise("STRUGGLING")
    return out.select(*PAIR, "attempts", "current", velocity.alias("velocity"), kind.alias("trend"))


def learning_velocity(attempts: DataFrame, minutes: Column) -> DataFrame:
    """Gain from the first to the last attempt per hour spent (0.1 at least); 1.0 for a single attempt."""
    at = F.struct("ts", "attempt_id")
    gain = F.max_by("score", at) - F.min_by("score", at)
    spent = F.greatest(F.lit(0.1), F.sum(minutes) / 60)
    return attempts.groupBy(*PAIR).agg(F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(gain / spent).alias("velocity"))


def history_text(attempts: DataFrame, last: int = 10) -> DataFrame:
    """The last interactions of each learner as one tagged line, oldest first."""
    newest = Window.partitionBy("learner_id").orderBy(F.desc("ts"), F.desc("attempt_id"))
    rows = attempts.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= last)
    item = F.concat(F.lit("concept "), F.col("concept_id").cast("string"), F.when(F.col("score") >= 0.6, " [CORRECT]").otherwise(" [INCORRECT]"))
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), item.alias("t")))), lambda x: x["t"])
    return rows.groupBy("learner_id").agg(F.concat(F.lit("[CLS] "), F.array_join(items, " \n ")).alias("history"))


def keep_last(rows: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def profile_changes(attempts: DataFrame, least: float = 0.1) -> DataFrame:
    """Attempts at which the learner's running mean score moved by more than `least`."""
    order = Window.partitionBy("learner_id").orderBy("ts", "attempt_id")
    rows = attempts.withColumn("mean", F.avg("score").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.lag("mean").over(order))
    return rows.filter(F.abs(F.col("mean") - F.col("before")) > least).select("learner_id", "attempt_id", "mean", "before")


def style_mismatch(attempts: DataFrame) -> DataFrame:
    """Learner and concept with two failures or more, all with one type of content."""
    out = attempts.filter("score < 0.4").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("content_type").alias("types"))
    return out.filter("failures >= 2 and types = 1").select(*PAIR, "failures")


def sessions(attempts: DataFrame, gap_minutes: int = 720) -> DataFrame:
    """Sessions of each learner: a gap longer than `gap_minutes` starts a new one."""
    order = Window.partitionBy("learner_id").orderBy("ts", "attempt_id")
    gap = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))) > gap_minutes * 60
    rows = attempts.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("learner_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"), F.countDistinct("concept_id").alias("concepts"))


def concept_episodes(attempts: DataFrame) -> DataFrame:
    at = F.struct("ts", "attempt_id")
    return attempts.groupBy(*PAIR).agg(F.min("ts").alias("first_seen"), (F.count(F.lit(1)) - 1).alias("revisits"), F.max_by("bloom", at).alias("level"), F.max_by("score", at).alias("last_score"))


#: States of the tutoring machine: phase, tries in it, and right ones in questioning.
STATES = [(0, 0, 0), (0, 1, 0), *[(1, t, r) for t in range(3) for r in range(2) if r <= t], *[(2, t, 0) for t in range(3)], (3, 0, 0)]


def tutored(state: tuple[int, int, int], right: bool) -> tuple[int, int, int]:
    """The state after one more turn: explanation ends after 2 turns, questioning after 2 right answers or 3 tries, practice after 3 tries."""
    phase, tries, good = state[0], state[1] + 1, state[2] + (state[0] == 1 and right)
    done = (phase == 0 and tries >= 2) or (phase == 1 and (good >= 2 or tries >= 3)) or (phase == 2 and tries >= 3)
    return (phase + 1, 0, 0) if done else (3, 0, 0) if phase == 3 else (phase, tries, good)


def dialogue_phases(turns: DataFrame) -> DataFrame:
    """The four-phase tutoring machine over the ordered turns of a conversation (see `tutored`).

    A turn is a table from state to state, and two tables are one table, so conversations of any length are composed in parts.
    """
    table = lambda right: F.array(*[F.lit(STATES.index(tutored(s, right))) for s in STATES])
    step = F.when(F.col("is_correct"), table(True)).otherwise(table(False))
    out = fold(turns, ["conv_id"], ["turn"], step, lambda f, g: F.transform(f, lambda x: F.element_at(g, x + 1)))
    names = F.array(*[F.lit(("EXPLANATION", "QUESTIONING", "PRACTICE", "ASSESSMENT")[s[0]]) for s in STATES])
    return out.select("conv_id", F.col("n").cast("int").alias("turns"), F.element_at(names, F.col("composed")[0] + 1).alias("phase"))


def interest_decay(attempts: DataFrame, rate: float = 0.95, drop: float = 0.1) -> DataFrame:
    """Weight of each concept of a learner after the evaluations that came later; below `drop` it goes."""
    total = F.count(F.lit(1)).over(Window.partitionBy("learner_id"))
    order = Window.partitionBy("learner_id").orderBy("ts", "attempt_id")
    rows = attempts.select("learner_id", "concept_id", (total - F.row_number().over(order)).alias("later"))
    weight = F.pow(F.lit(rate), F.min("later"))
    return rows.groupBy("learner_id", "concept_id").agg(weight.alias("weight")).filter(F.col("weight") >= drop)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def note_synthesis(notes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The concepts that the notes of a learner lead to most: learner_id, other, n (pairs of different notes, one of a concept with an edge
    (source, target) to the other's), rank. Notes are counted by learner and concept, and counts are multiplied: no pair of notes is formed."""
    counts = notes.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy(F.col("source").alias("concept_id"), F.col("target").alias("other")).agg(F.count(F.lit(1)).alias("e"))
    met = counts.join(e, "concept_id").join(counts.select("learner_id", F.col("concept_id").alias("other"), F.col("n").alias("m")), ["learner_id", "other"])
    own = F.when(F.col("concept_id") == F.col("other"), F.col("m")).otherwise(0)  # a note is no partner of its own
    n = met.groupBy("learner_id", "other").agg(F.sum(F.col("e") * (F.col("n") * F.col("m") - own)).alias("n")).filter("n > 0")
    return keep_last(n, "learner_id", [F.desc("n"), F.col("other")], top)


def related_notes(notes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Up to `most` notes that a note is linked with by an edge between their concepts, the first by id: note_id, linked, rank.

    Of each learner and concept only the first `most` + 1 notes enter the join (one may be the note itself), so a note meets no more for an edge.
    """
    first = keep_last(notes.select("note_id", *PAIR), PAIR, [F.col("note_id")], most + 1).select("learner_id", F.col("concept_id").alias("other"), F.col("note_id").alias("linked"))
    e = edges.select(F.col("source").alias("concept_id"), F.col("target").alias("other")).distinct()
    met = notes.select("note_id", *PAIR).join(e, "concept_id").join(first, ["learner_id", "other"]).filter("note_id <> linked")
    return keep_last(met.select("note_id", "linked").distinct(), "note_id", [F.col("linked")], most)
