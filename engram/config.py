"""Default parameters.  Passed to operators as arguments, never read globally by them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # They decide results and equal the published defaults.
    rrf_k: int = 60
    lexical_limit: int = 100
    vector_limit: int = 100
    evolution_limit: int = 300
    chunk_limit: int = 30
    procedural_limit: int = 5
    batch_summary_limit: int = 3
    conversation_summary_limit: int = 2
    max_per_conversation: int = 3
    max_per_turn: int = 2
    recency_boost: float = 0.25
    recency_tau_days: float = 30.0
    visible_decay: float = 0.2
    bonus_keyword: float = 1.0
    bonus_long: float = 1.5
    bonus_substantial: float = 0.5
    penalty_short: float = -0.7
    bonus_recent_10: float = 1.0
    bonus_recent_30: float = 0.5
    bonus_min: float = -0.9
    bonus_max: float = 4.0
    long_words: int = 800
    substantial_words: int = 400
    short_words: int = 80
    recency_min_turns: int = 20
    session_gap_minutes: int = 30
    decay_cycles_per_day: float = 16.0
    decay_unaccessed: float = 0.95
    decay_accessed: float = 0.98
    decay_creative: float = 0.99
    archive_threshold: float = 0.1
    cold_threshold: float = 0.05
    creative_floor: float = 0.3
    edge_decay_daily: float = 0.99
    edge_demotion: float = 0.3
    edge_expiry: float = 0.1
    edge_recency_boost: float = 0.3
    edge_recency_tau_days: float = 30.0
    direct_trust: float = 0.5
    deep_trust: float = 1.0
    max_depth: int = 3
    lossless_density: float = 0.35
    raw_keep_words: int = 350
    coverage_threshold: float = 0.7
    chunk_tokens: int = 550
    chunk_overlap_words: int = 50
    import_recent_days: int = 30
    import_immune_days: int = 14
    context_fraction: float = 0.75
    context_min: int = 4_000
    context_max: int = 40_000
    context_fallback: int = 23_000
    context_reserve: int = 2_048
    overhead: int = 1_800
    cluster_band: float = 0.8
    cluster_floor: float = 0.5
    cluster_top: int = 10


DEFAULTS = Defaults()
