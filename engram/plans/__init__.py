"""The registered queries and their oracle SQL."""

from __future__ import annotations

from engram.plans import assemble, audit, entities, evaluate, extra, graph, legs, lifecycle, records, retrieve, seams, sequential, text, upkeep

FAMILIES = (text.PLANS, retrieve.PLANS, graph.PLANS, lifecycle.PLANS, evaluate.PLANS, records.PLANS, extra.PLANS, sequential.PLANS, assemble.PLANS, upkeep.PLANS, audit.PLANS, seams.PLANS, entities.PLANS, legs.PLANS)
QUERIES = {name: f for plans in FAMILIES for name, f in plans.queries.items()}
ORACLES = {name: sql for plans in FAMILIES for name, sql in plans.oracles.items()}
