"""Constants of the engine.  Thresholds are parameters; these are their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    chunk_words: int = 450
    overlap_words: int = 75
    min_text_chars: int = 100
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    dense_k: int = 4
    lexical_k: int = 4
    fused_k: int = 8
    rrf_k: int = 60
    existence_accept: float = 0.75 * 0.85
    existence_strong: float = 0.85
    subset_score: float = 0.90
    support_tau: float = 0.70
    support_uncertain: float = 0.40
    window_chars: int = 450
    window_step: int = 350
    window_reach: int | None = None
    support_chars: int = 500
    support_step: int = 350
    support_reach: int | None = None
    max_rounds: int = 2
    avg_weak: float = 0.60
    min_weak: float = 0.40
    challenge_strong: float = 0.5
    min_gaps: int = 1
    cache_distance: float = 0.08
    risk_threshold: float = 0.45
    risk_k: int = 5
    fuzzy_known: int = 85
    fuzzy_identity: int = 80
    answer_similar: float = 0.70
    consensus_confidence: float = 0.80
    consensus_ccs: float = 0.75
    converged_confidence: float = 0.70


DEFAULTS = EngineConfig()

#: Windows of the beginnings of texts alone, over which support_windows and support_tiers are stated; reviews read all of a text.
BEGINNINGS = replace(DEFAULTS, window_reach=1800, support_step=500, support_reach=500)

TIERS = ("SUPPORTED", "UNCERTAIN", "MISATTRIBUTED", "FABRICATED", "UNVERIFIABLE")
RISKY_TIERS = ("FABRICATED", "MISATTRIBUTED", "UNVERIFIABLE", "LIKELY_FAKE")

# Words left out when citations are compared, for scoring and for reconciliation.
SCORING_STOP_WORDS = ("the", "and", "for", "state", "court", "united", "states")
RECONCILING_STOP_WORDS = ("the", "and", "for", "state", "court")

# Volumes of the landmark selection.
LANDMARK_VOLUMES = (
    "347", "367", "372", "373", "376", "381", "384", "389", "392", "410", "411", "413", "466", "467",
    "476", "509", "514", "533", "543", "554", "558", "560", "567", "573", "576", "585", "587",
)

# Well-known cases that local collections do not hold.
OFF_CORPUS_CASES = (
    "lockett v. ohio",
    "argersinger v. hamlin",
    "milliken v. bradley",
    "moran v. burbine",
    "gertz v. robert welch, inc.",
    "arkansas v. sanders",
    "california v. acevedo",
    "city of arlington v. fed. commc'ns comm'n",
    "bellotti v. baird",
    "first national bank v. bellotti",
    "milkovich v. lorain journal co.",
    "g.m. leasing corp. v. united states",
    "kolender v. lawson",
    "marbury v. madison",
    "mcculloch v. maryland",
    "gibbons v. ogden",
    "loving v. virginia",
    "tinker v. des moines",
    "new york v. quarles",
)

# The variants of an ablation, as (name, defense, scoring, memory, rounds).
ABLATIONS = (
    ("full", True, True, True, 2),
    ("no_defense", False, True, True, 2),
    ("no_scoring", True, False, True, 2),
    ("no_memory", True, True, False, 2),
    ("single_round", True, True, True, 1),
)
