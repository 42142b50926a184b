"""Sequential selections of one query's candidates: token budget and coverage.  Grouped maps: a query's candidates are bounded by the legs' limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BUDGET_SCHEMA = "query_id long, id long, place int, form string, tokens long"


def pack_budget(frame: pd.DataFrame, budget: int) -> list[tuple[int, str, int]]:
    """(id, form, tokens) in order: each leg's best first, then rounds over the legs; what is too long falls back to its summary, then its abstract.

    ``frame`` has id, leg, score, tokens, summary_tokens and abstract_tokens (null: none).
    """
    rows = frame.sort_values(["leg", "score", "id"], ascending=[True, False, True])
    queues = {leg: list(part.itertuples()) for leg, part in rows.groupby("leg", sort=True)}
    out: list[tuple[int, str, int]] = []
    left = budget

    def take(row) -> bool:
        nonlocal left
        for form, size in (("full", row.tokens), ("summary", row.summary_tokens), ("abstract", row.abstract_tokens)):
            if not pd.isna(size) and size <= left:
                out.append((row.id, form, int(size)))
                left -= int(size)
                return True
        return False

    by_head = lambda leg: (-queues[leg][0].score, leg)
    for leg in sorted(queues, key=by_head):
        if take(queues[leg][0]):
            queues[leg].pop(0)
    queues = {leg: q for leg, q in queues.items() if q}
    while queues and left > 0:
        moved = False
        for leg in sorted(queues, key=by_head):
            moved |= take(queues[leg].pop(0))
        queues = {leg: q for leg, q in queues.items() if q}
        if not moved:
            break
    return out


def token_budget(candidates: DataFrame, budget: int) -> DataFrame:
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], i, n, form, t) for n, (i, form, t) in enumerate(pack_budget(frame, budget))]
        return pd.DataFrame(rows, columns=["query_id", "id", "place", "form", "tokens"])

    return candidates.groupBy("query_id").applyInPandas(run, BUDGET_SCHEMA)


def knee(gains: list[float], prominence: float, least: int) -> int | None:
    """Where the cumulative gain lies furthest above its chord, if that is prominent."""
    total = sum(gains)
    if len(gains) <= least or total <= 1e-9:
        return None
    y = np.cumsum(gains) / total
    above = y - (y[0] + np.linspace(0, 1, len(gains)) * (y[-1] - y[0]))
    at = int(above.argmax())
    return max(least, at + 1) if above[at] >= prominence else None


def cover(query: np.ndarray, vectors: np.ndarray, scores: np.ndarray, alpha=0.7, min_gain=0.02, least=2, most=40, prominence=0.08) -> tuple[list[int], str]:
    """Greedy residual pursuit: (chosen rows in order, why it stopped)."""
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    rest, vectors = unit(np.asarray(query, float)), np.array([unit(v) for v in vectors])
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    normed = 1 - rank / max(1, len(scores) - 1)
    free, chosen, gains, why = np.ones(len(scores), bool), [], [], "exhausted"
    while free.any():
        if len(chosen) == most:
            why = "max_keep"
            break
        gain = np.abs(vectors @ rest)
        best = int(np.where(free, alpha * gain + (1 - alpha) * normed, -np.inf).argmax())
        if gain[best] < min_gain and len(chosen) >= least:
            why = "min_gain"
            break
        chosen.append(best)
        gains.append(float(gain[best]))
        free[best] = False
        rest = rest - (rest @ vectors[best]) * vectors[best]
        size = np.linalg.norm(rest)
        if size <= 1e-9:
            why = "residual_exhausted"
            break
        rest = rest / size
    cut = knee(gains, prominence, least) if len(chosen) > least else None
    return (chosen[:cut], "knee") if cut else (chosen, why)


def coverage(candidates: DataFrame) -> DataFrame:
    """(query_id, id, place, why) of candidates (query_id, id, score, vector or null, query); those without a vector come first."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True])
        bare, placed = frame[frame["vector"].isna()], frame[frame["vector"].notna()]
        ids, why = bare["id"].tolist(), "no_vectors"
        if len(placed):
            at, why = cover(placed["query"].iloc[0], np.stack(placed["vector"].to_numpy()), placed["score"].to_numpy())
            ids += placed["id"].iloc[at].tolist()
        return pd.DataFrame({"query_id": key[0], "id": ids, "place": range(len(ids)), "why": why})

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, id long, place int, why string")

