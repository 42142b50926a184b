"""Closed-form decisions, budgets and rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Defaults
from engram.sources.driver import DAY_US

# Brackets of the budget ladders, (turns below, value).
RECENT_FRACTIONS = ((10, 0.3), (50, 0.2), (200, 0.2), (500, 0.15))
RECENT_DEFAULT = 0.15
DENSITY_SHIFTS = ((3000, -0.15), (1500, -0.10), (800, -0.05))
GROWTH_CAPS = ((30, 2_000, 150), (100, 5_000, 100), (500, 10_000, 30))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return F.ln(p / (1 - p))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.lit(float(DAY_US))


def recency(us: Column, centre: Column, boost: float, tau_days: float) -> Column:
    return 1 + F.lit(boost) * F.exp(-days_between(us, centre) / F.lit(tau_days))


def edge_trust(strength: Column, confidence: Column, valid_from: Column, centre: Column, cfg: Defaults = DEFAULTS) -> Column:
    base = F.coalesce(strength, F.lit(0.0)) * F.coalesce(confidence, F.lit(1.0))
    fresh = F.when(valid_from.isNotNull(), recency(valid_from, centre, cfg.edge_recency_boost, cfg.edge_recency_tau_days)).otherwise(1.0)
    return base * fresh


def recent_fraction(turns: Column, tokens: Column) -> Column:
    """Share of the budget for recent turns: by length, less for conversations of long turns, within [.05, .85]."""
    base = F.lit(RECENT_DEFAULT)
    for below, value in reversed(RECENT_FRACTIONS):
        base = F.when(turns < below, F.lit(value)).otherwise(base)
    shift, mean = F.lit(0.0), tokens / F.greatest(turns, F.lit(1))
    for above, delta in reversed(DENSITY_SHIFTS):
        shift = F.when(mean > above, F.lit(delta)).otherwise(shift)
    return F.least(F.lit(0.85), F.greatest(F.lit(0.05), base + F.when((turns > 0) & (tokens > 0), shift).otherwise(0.0)))


def growth_cap(turns: Column, otherwise: Column) -> Column:
    cap, edge = otherwise, 0
    for n, (below, base, each) in reversed(list(enumerate(GROWTH_CAPS))):
        edge = GROWTH_CAPS[n - 1][0] if n else 0
        cap = F.when(turns < below, F.lit(base) + (turns - edge) * each).otherwise(cap)
    return cap


def retrieval_budget(turns: Column, tokens: Column, total: Column, cfg: Defaults = DEFAULTS) -> Column:
    """struct(recent, retrieval) of a total budget."""
    available = total - cfg.overhead
    recent = F.floor(available * recent_fraction(turns, tokens)).cast("long")
    return F.struct(recent.alias("recent"), F.least(available - recent, growth_cap(turns, available - recent)).cast("long").alias("retrieval"))


def model_budget(window: Column, cfg: Defaults = DEFAULTS) -> Column:
    """Total budget of a model's window, never more than it can hold beside the answer."""
    wanted = F.greatest(F.lit(cfg.context_min), F.least(F.lit(cfg.context_max), F.floor(window * cfg.context_fraction)))
    usable = window - cfg.context_reserve
    usable = F.when(usable <= 0, F.greatest(F.lit(1), F.floor(window / 2))).otherwise(usable)
    return F.when(F.coalesce(window, F.lit(0)) == 0, F.lit(cfg.context_fallback)).otherwise(F.least(wanted, usable)).cast("long")


# Fixed values of the memory decision.
PRIOR_BIAS, LENGTH_WEIGHT, MIDPOINT, SCALE = 0.4, 0.8, 2000, 4000
BUMPS = {"creative": 0.7, "referential": 0.5, "unsure": 0.8, "timed": 3.0, "coding": 0.7}


def memory_decision(p_ltm: Column, turns: Column, tokens: Column, creative: Column, referential: Column, unsure: Column, timed: Column, coding: Column, total: float = 23_000, cfg: Defaults = DEFAULTS) -> Column:
    """struct(p_len, p_need, retrieve): prior log-odds, history beyond the window, and feature bumps."""
    share = F.when(turns < 10, 0.3).when(turns < 200, 0.2).otherwise(0.15)
    beyond = F.greatest(F.lit(0.0), tokens - share * (total - cfg.overhead))
    p_len = sigmoid(F.greatest(F.lit(0.0), beyond - MIDPOINT) / SCALE)
    odds = logit(p_ltm) + PRIOR_BIAS + LENGTH_WEIGHT * logit(p_len)
    for name, flag in (("creative", creative), ("referential", referential), ("unsure", unsure), ("timed", timed), ("coding", coding)):
        odds = odds + F.when(flag, BUMPS[name]).otherwise(0.0)
    need = sigmoid(odds)
    return F.struct(p_len.alias("p_len"), need.alias("p_need"), (need > 0.5).alias("retrieve"))


def cycle_rate(daily: Column, cfg: Defaults = DEFAULTS) -> Column:
    return F.pow(daily, F.lit(1 / cfg.decay_cycles_per_day))


def missed_cycles(elapsed_us: Column, interval_us: int, most: int = 96) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(elapsed_us / interval_us))).cast("int")


def import_decay(policy: str, us: Column, now_us: int, creative: Column, cfg: Defaults = DEFAULTS) -> Column:
    """struct(score, immune_until, is_archived) of an imported turn under a decay policy."""
    age = F.greatest(F.lit(0.0), (F.lit(now_us) - us) / F.lit(float(DAY_US)))
    immune = F.lit(now_us + cfg.import_immune_days * DAY_US)
    none = F.lit(None).cast("long")
    keep = F.struct(F.lit(1.0).alias("score"), immune.cast("long").alias("immune_until"), F.lit(False).alias("is_archived"))
    if policy == "fresh":
        return F.struct(F.lit(1.0).alias("score"), none.alias("immune_until"), F.lit(False).alias("is_archived"))
    if policy == "preserve":
        return keep
    if policy not in ("hybrid", "fast_forward"):
        raise ValueError(f"unknown decay policy {policy!r}")
    aging = age - cfg.import_recent_days if policy == "hybrid" else age
    raw = F.pow(F.when(creative, cfg.decay_creative).otherwise(cfg.decay_unaccessed), aging)
    score = F.when(creative, F.greatest(raw, F.lit(cfg.creative_floor))).otherwise(F.greatest(raw, F.lit(cfg.cold_threshold)))
    aged = F.struct(score.alias("score"), none.alias("immune_until"), (~creative & (score < cfg.archive_threshold)).alias("is_archived"))
    return F.when(age <= cfg.import_recent_days, keep).otherwise(aged) if policy == "hybrid" else aged


def observed_window(runtime: Column, claimed: Column, architecture: Column) -> Column:
    return F.least(F.coalesce(runtime, claimed), F.coalesce(architecture, runtime, claimed))
