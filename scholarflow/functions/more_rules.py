"""More scalar rules: grounding, profiles, context and domain names, note text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import clamp, sanitize


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def three_way(semantic: Column, structural: Column, contextual: Column, weights: tuple[float, float, float] = (0.60, 0.30, 0.10)) -> Column:
    return weights[0] * semantic + weights[1] * structural + weights[2] * contextual


def completeness(parts: list[tuple[Column, float]]) -> Column:
    """Sum of the weights of the parts that hold."""
    total = F.lit(0.0)
    for on, weight in parts:
        total = total + F.when(F.coalesce(on, F.lit(False)), weight).otherwise(0.0)
    return total


def grounding_boost(definition: Column, examples: Column, errors: Column, bloom: Column) -> Column:
    return F.least(F.lit(1.0), completeness([(definition, 0.3), (examples >= 2, 0.3), (errors, 0.2), (bloom.isin("APPLY", "ANALYZE", "EVALUATE"), 0.2)]))


def grounding_confidence(distance: Column, filled: Column, personal: Column) -> Column:
    """Document (0.40), course (0.35) and personal (0.25) layers."""
    return 0.4 * F.when(distance.isNull(), 0.0).otherwise(1.0 / (1.0 + distance)) + 0.35 * filled / 3 + 0.25 * F.when(personal, 1.0).otherwise(0.0)


def prior_mastery(level: Column, difficulty: Column) -> Column:
    by = F.when(level == "beginner", 0.1).when(level == "intermediate", 0.5).when(level == "advanced", 0.8).otherwise(0.2)
    return clamp(by * (1 - (difficulty - 1) * 0.1))


def profile_vector(mastery: Column, style: Column, level: Column, time: Column, bloom: Column, velocity: Column, topic: Column) -> Column:
    """Ten numbers in [0, 1] that describe a learner; an unknown style is spread evenly."""
    styles = ("VISUAL", "AUDITORY", "READING", "KINESTHETIC")
    one_hot = [F.when(style.isin(*styles), (style == s).cast("double")).otherwise(0.25) for s in styles]
    skill = F.when(level == "BEGINNER", 0.2).when(level == "INTERMEDIATE", 0.5).when(level == "ADVANCED", 0.8).otherwise(0.2)
    return F.array(F.least(mastery, F.lit(1.0)), *one_hot, skill, F.least(time / 500.0, F.lit(1.0)), bloom, F.least(velocity / 5.0, F.lit(1.0)), F.least(F.length(topic) / 50.0, F.lit(1.0)))


def bloom_weight(bloom: Column) -> Column:
    out = F.lit(0.1)
    for name, w in (("UNDERSTAND", 0.3), ("APPLY", 0.5), ("ANALYZE", 0.7), ("EVALUATE", 0.85), ("CREATE", 1.0)):
        out = F.when(bloom == name, w).otherwise(out)
    return out


def pace(done: Column, hours: Column, ratio: Column) -> tuple[Column, Column, Column]:
    """Velocity, next difficulty, and the event that an unusual velocity raises."""
    velocity = F.when(hours > 0, done / hours).otherwise(0.0)
    step = F.when(ratio > 1.2, "HARD").when(ratio < 0.8, "EASY").otherwise("MEDIUM")
    event = F.when(F.abs(velocity - 1.0) > 0.3, F.when(velocity > 1.0, "LEARNER_ACCELERATING").otherwise("LEARNER_SLOWING"))
    return velocity, step, event


def error_type(score: Column, careless: Column, procedural: Column, similarity: Column, known: Column) -> Column:
    """Kind of error from the score, with the text checks that its range asks for."""
    return (
        F.when(score >= 0.95, "CORRECT").when(score >= 0.80, F.when(careless, "CARELESS").otherwise("INCOMPLETE")).when(score >= 0.60, F.when(procedural, "PROCEDURAL").otherwise("INCOMPLETE"))
        .when(similarity < 0.3, F.when(known, "CONCEPTUAL").otherwise("PROCEDURAL")).otherwise("INCOMPLETE")
    )


def careless(learner: Column, expected: Column, similarity: Column) -> Column:
    """Nearly the same text, the same but for case and space, or the same count of numbers, all within 1."""
    bare = lambda c: F.translate(F.lower(c), " \n", "")
    numbers = lambda c: F.filter(F.transform(F.split(c, r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    a, b = numbers(learner), numbers(expected)
    close = (F.size(a) > 0) & (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1), lambda ok: ok)
    return (similarity >= 0.90) | (bare(learner) == bare(expected)) | close


#: Keywords that come in this order in a query, and those that must not be missing.
KEYWORD_PAIRS = (("SELECT", "FROM"), ("FROM", "WHERE"), ("WHERE", "GROUP BY"), ("GROUP BY", "HAVING"), ("HAVING", "ORDER BY"))
KEYWORDS = ("SELECT", "FROM", "WHERE", "JOIN", "GROUP BY")


def procedural(learner: Column, expected: Column) -> Column:
    """Keywords in another order than expected, or missing."""
    a, b = F.upper(learner), F.upper(expected)
    out = F.lit(False)
    for x, y in KEYWORD_PAIRS:
        there = F.contains(a, F.lit(x)) & F.contains(a, F.lit(y)) & F.contains(b, F.lit(x)) & F.contains(b, F.lit(y))
        out = out | (there & ((F.instr(a, x) > F.instr(a, y)) != (F.instr(b, x) > F.instr(b, y))))
    for k in KEYWORDS:
        out = out | (F.contains(b, F.lit(k)) & ~F.contains(a, F.lit(k)))
    return out


def normalize_context(text: Column) -> tuple[Column, Column, Column]:
    """Key of up to three words and 32 characters, how many words it has, and the words that did not fit."""
    clean = sanitize(F.coalesce(text, F.lit("")))
    words = F.split(F.when(clean == "", "general").otherwise(clean), "_")
    key = F.rtrim(F.substring(F.array_join(F.slice(words, 1, 3), "_"), 1, 32), F.lit("_"))
    return key, F.least(F.size(words), F.lit(3)), F.array_join(F.slice(words, 4, 1000), ",")


def tags(concept: Column, connections: Column, insight: Column) -> Column:
    """Concept, three connections and five long words of the insight; distinct, sorted, ten at most."""
    words = F.transform(F.filter(F.split(insight, r"\s+"), lambda w: (F.length(w) > 4) & w.rlike("^[A-Za-z]+$")), lambda w: F.lower(w))
    return F.slice(F.array_sort(F.array_distinct(F.concat(F.array(concept), F.slice(connections, 1, 3), F.slice(words, 1, 5)))), 1, 10)


def note_markdown(title: Column, insight: Column, links: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("## Key insight\n"), insight), F.when(F.size(links) > 0, F.concat(F.lit("## Connections\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), x)), "\n"))))


def sanitize_prompt(text: Column) -> Column:
    out = text
    for tag, safe in (("<system>", "[system]"), ("</system>", "[/system]"), ("```", "'''")):
        out = F.replace(out, F.lit(tag), F.lit(safe))
    return out


def simple_score(text: Column) -> tuple[Column, Column]:
    """`SCORE: n` over 100 (0.5 if there is none) and the justification line."""
    n = F.regexp_extract(text, r"(?i)SCORE:\s*(\d+)", 1)
    why = F.trim(F.regexp_extract(text, r"(?i)JUSTIFICATION:\s*([^\n]+)", 1))
    return F.when(n == "", 0.5).otherwise(n.cast("double") / 100), F.when(why == "", "Could not parse").otherwise(why)


def first_line_score(text: Column) -> Column:
    """All digits of the first line as one number over 100, 1 at most; 0.5 if there are none, or no text."""
    digits = F.regexp_replace(F.element_at(F.split(text, "\n"), 1), "[^0-9]", "")
    number = F.regexp_replace(digits, "^0+", "")
    return F.when(F.coalesce(digits, F.lit("")) == "", 0.5).when(F.length(number) > 3, 1.0).otherwise(F.least(F.lit(1.0), F.concat(F.lit("0"), number).cast("double") / 100))


def probability(text: Column) -> Column:
    """The first number from 0 to 1 that a text holds (a leading 0 or 1 of a longer number counts); 0.5 if there is none, or no text."""
    found = F.regexp_extract(text, r"0\.[0-9]+|1\.0|0|1", 0)
    return F.when(F.coalesce(found, F.lit("")) == "", 0.5).otherwise(F.least(F.lit(1.0), found.cast("double")))


def parse_code(code: Column, default: str = "general") -> tuple[Column, Column, Column]:
    """Domain, context and concept of a dotted code; two parts are domain and concept."""
    p = F.split(code, r"\.")
    n = F.size(p)
    rest = F.array_join(F.slice(p, 3, 1000), ".")
    return F.when(n >= 2, p[0]).otherwise(default), F.when(n >= 3, p[1]).otherwise("concept"), F.when(n >= 3, rest).when(n == 2, F.element_at(p, 2)).otherwise(p[0])


#: Fixed phrases and what a teacher says instead.
GROWTH_PHRASES = {
    "you can't": "you haven't learned how to yet",
    "you're not good at": "you're developing skill in",
    "it's too hard": "it's challenging, which helps you learn",
    "you'll never": "with practice, you can",
}


def growth_phrases(text: Column) -> Column:
    out = text
    for phrase, instead in GROWTH_PHRASES.items():
        out = F.regexp_replace(out, f"(?i){phrase}", instead)
    return out


def shorten(text: Column, words: int) -> Column:
    """A text of more than `words` words cut to the first half of its sentences, two at least."""
    parts = F.split(text, r"\. ")
    half = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.lit(2), F.floor(F.size(parts) / 2).cast("int"))), ". "), F.lit("."))
    return F.when(F.size(F.split(text, " ")) > words, half).otherwise(text)


def numbered(text: Column) -> Column:
    """The first five sentences as numbered lines; a single sentence stays."""
    parts = F.split(text, r"\. ")
    lines = F.transform(F.slice(parts, 1, 5), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(parts) > 1, F.array_join(lines, "\n")).otherwise(text)


def domain_score(text: Column, key: Column, name: Column, aliases: Column) -> Column:
    """How well a text names a domain: its key, its full name, or its best alias, where longer ones are better."""
    parts = F.transform(aliases, lambda a: F.when(a == text, 0.95).when(F.contains(text, a), F.least(F.lit(0.85), 0.6 + F.length(a) / 50)).otherwise(0.0))
    return F.when(text == key, 1.0).when(F.contains(text, key), 0.9).when(F.contains(text, F.lower(name)), 0.95).otherwise(F.coalesce(F.array_max(parts), F.lit(0.0)))
