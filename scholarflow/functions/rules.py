"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BASE_HOURS, BLOOM, CONFIG, DIFFICULTY_MULTIPLIER


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def note_type_simple(score: Column) -> Column:
    return F.when(score < CONFIG.proceed, "MISCONCEPTION_NOTE").otherwise("ATOMIC_NOTE")


def note_type(score: Column, has_misconceptions: Column, error: Column) -> Column:
    weak = (score < 0.5) & (has_misconceptions | (error == "CONCEPTUAL"))
    return F.when(weak, "MISCONCEPTION_NOTE").when(score >= 0.75, "ATOMIC_NOTE").otherwise("SUMMARY_NOTE")


def content_type(difficulty: Column, style: Column) -> Column:
    return F.when(difficulty <= 2, "TUTORIAL").when(style == "VISUAL", "VIDEO").when(style == "READING", "ARTICLE").otherwise("EXERCISE")


def path_decision(score: Column, mastery: Column, error: Column, difficulty: Column) -> Column:
    """Next step from a score; hard concepts and learners who are already good get lower thresholds."""
    ease = F.when(difficulty >= 4, CONFIG.difficulty_adjustment).otherwise(0.0)
    boost = F.when(mastery >= 0.7, CONFIG.mastery_boost).otherwise(0.0)
    return (
        F.when(score >= CONFIG.mastered - ease - boost, "MASTERED")
        .when(score >= CONFIG.proceed - ease, "PROCEED")
        .when(score >= CONFIG.alternate - ease, "ALTERNATE")
        .when(error == "CONCEPTUAL", "REMEDIATE")
        .otherwise("RETRY")
    )


def decision_table(mastery: Column, error: Column, severe: Column, conceptual: Column, persistent: Column, mismatch: Column) -> Column:
    """Next step from mastery and what is known of misconceptions; the order of the rows matters."""
    return (
        F.when((mastery >= 0.9) & ~severe, "MASTERED")
        .when((mastery >= 0.8) & ~conceptual, "PROCEED")
        .when((mastery >= 0.6) & (error == "CARELESS"), "PROCEED")
        .when((mastery >= 0.6) & conceptual, F.when(mismatch, "ALTERNATE").otherwise("RETRY"))
        .when((mastery < 0.6) & (persistent | conceptual), "REMEDIATE")
        .when(mastery < 0.4, "REMEDIATE")
        .otherwise("RETRY")
    )


#: Fixed texts by decision.
SUGGESTIONS = {
    "MASTERED": "Ready to skip ahead to advanced topics",
    "PROCEED": "Can move to next concept",
    "ALTERNATE": "Try different example or teaching angle",
    "RETRY": "Same concept, new question",
    "REMEDIATE": "Must go back to prerequisites",
}


def suggestion(decision: Column) -> Column:
    out = F.lit("Continue learning")
    for name, text in SUGGESTIONS.items():
        out = F.when(decision == name, text).otherwise(out)
    return out


def decision_confidence(decision: Column, mastery: Column) -> Column:
    return F.when(decision.isin("MASTERED", "PROCEED"), F.least(F.lit(1.0), mastery + 0.1)).otherwise(0.6)


def reward(score: Column, passed: Column, risk: Column) -> Column:
    """Bandit reward; an unknown risk counts 0 when passed and 0.2 when failed."""
    known = F.coalesce(risk, F.when(passed, 0.0).otherwise(CONFIG.unknown_risk))
    return CONFIG.reward_score * score + CONFIG.reward_passed * F.when(passed, 1.0).otherwise(0.0) - CONFIG.reward_risk * known


def gate_probability(score: Column) -> Column:
    return F.least(F.lit(1.0), score / CONFIG.gate)


def initial_mastery(difficulty: Column) -> Column:
    return F.greatest(F.lit(0.1), 0.5 - difficulty * 0.08)


def hours(difficulty: Column, velocity: Column) -> Column:
    by = F.create_map(*[F.lit(x) for kv in DIFFICULTY_MULTIPLIER.items() for x in kv])
    return F.lit(BASE_HOURS) * F.coalesce(F.element_at(by, difficulty), F.lit(1.0)) / velocity


def pacing(used: Column, total: Column, steps: Column) -> Column:
    share = used / total
    return F.when((steps == 0) | (total <= 0), "NO_PATH").when(share > 0.9, "AGGRESSIVE").when(share > 0.7, "MODERATE").otherwise("RELAXED")


def bloom_level(score: Column, difficulty: Column, question: Column) -> Column:
    """Bloom level from score (0.60), difficulty (0.25) and question type (0.15), rounded half to even."""
    by_score = F.when(score < 0.2, 1).when(score < 0.4, 2).when(score < 0.6, 3).when(score < 0.8, 4).when(score < 0.9, 5).otherwise(6)
    shift = F.when(difficulty >= 4, -0.5).when(difficulty <= 2, 0.5).otherwise(0.0)
    boost = F.when(question == "conceptual", 0.3).when(question == "application", 0.7).when(question == "synthesis", 1.0).otherwise(0.0)
    mixed = 0.60 * by_score + 0.25 * (by_score + shift) + 0.15 * (by_score + boost)
    at = F.bround(F.least(F.lit(6.0), F.greatest(F.lit(1.0), mixed))).cast("int")
    return F.element_at(F.array(*[F.lit(b) for b in BLOOM]), at)


def learning_gain(pre: Column, post: Column) -> Column:
    return F.when(pre >= 99.9, 0.0).otherwise(clamp((post - pre) / (100.0 - pre), -1.0, 1.0))


def retention_decay(post: Column, later: Column) -> Column:
    return F.when(post < 1.0, 0.0).otherwise(F.greatest(F.lit(0.0), (post - later) / post))


def effect_band(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def review_priority(mastery: Column) -> Column:
    """Ebbinghaus: how likely a concept is forgotten, times how well it was known."""
    days = F.floor((1 - mastery) * 30) + 1
    return (1 - F.exp(-days / F.greatest(F.lit(1.0), mastery * 30))) * mastery


def sanitize(text: Column) -> Column:
    low = F.translate(F.lower(text), "- ", "__")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_]", ""), "_+", "_"), "^_|_$", "")


def concept_code(domain: Column, name: Column, default: str = "general") -> Column:
    clean = sanitize(F.coalesce(domain, F.lit("")))
    return F.concat_ws(".", F.when(clean == "", default).otherwise(clean), sanitize(name))


def valid_code(code: Column) -> Column:
    parts = F.split(code, r"\.")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike("^[a-z][a-z0-9_]*$"))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of lower-case words; 0 if both are empty."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)


def answer_score(similarity: Column, judge: Column, grounding: Column, answer: Column) -> tuple[Column, Column]:
    """Score and confidence of an answer; an empty one scores 0 with confidence 0.9."""
    empty = F.coalesce(F.trim(answer), F.lit("")) == ""
    score = clamp(0.4 * similarity + 0.5 * judge + 0.1 * grounding)
    sure = clamp((1.0 - F.abs(similarity - judge)) * 0.7 + grounding * 0.3, 0.3, 1.0)
    return F.when(empty, 0.0).otherwise(score), F.when(empty, 0.9).otherwise(sure)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
