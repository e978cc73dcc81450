"""Thresholds and weights, in one place. All are fixed values of the learning model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # analysis of concepts
    min_learners: int = 5
    difficult_below: float = 0.4
    easy_above: float = 0.8
    struggle_below: float = 0.5
    priority_struggle: float = 0.6
    moderate_struggle: float = 0.3
    # decisions
    mastered: float = 0.9
    proceed: float = 0.8
    alternate: float = 0.6
    alert: float = 0.4
    prerequisite: float = 0.7
    difficulty_adjustment: float = 0.05
    mastery_boost: float = 0.03
    # moving average of mastery: history and session weights, Bloom step
    history_weight: float = 0.7
    session_weight: float = 0.3
    bloom_step: float = 0.05
    # knowledge tracing
    learn: float = 0.1
    guess: float = 0.25
    slip: float = 0.1
    # bandit reward
    reward_score: float = 0.6
    reward_passed: float = 0.4
    reward_risk: float = 0.5
    unknown_risk: float = 0.2
    # path success
    success_mastery: float = 0.4
    success_time: float = 0.4
    success_difficulty: float = 0.2
    gate: float = 0.8


CONFIG = Config()

BLOOM = ("REMEMBER", "UNDERSTAND", "APPLY", "ANALYZE", "EVALUATE", "CREATE")
RELATIONS = ("REQUIRES", "IS_PREREQUISITE_OF", "NEXT", "REMEDIATES", "HAS_ALTERNATIVE_PATH", "SIMILAR_TO", "IS_SUB_CONCEPT_OF")
CHAIN_MODES = {
    "FORWARD": ("NEXT", "IS_PREREQUISITE_OF"),
    "BACKWARD": ("REQUIRES",),
    "LATERAL": ("SIMILAR_TO", "HAS_ALTERNATIVE_PATH", "REMEDIATES"),
    "ACCELERATE": ("NEXT", "IS_SUB_CONCEPT_OF"),
    "REVIEW": ("REQUIRES",),
}
#: Hours of a concept by difficulty are the base times the multiplier.
BASE_HOURS, DIFFICULTY_MULTIPLIER = 0.5, {1: 0.5, 2: 0.8, 3: 1.0, 4: 1.5, 5: 2.0}
#: Difference to the next ordinal that counts as "now" in derived tables.
NOW = "2024-01-31 00:00:00"
