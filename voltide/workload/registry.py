"""All registered queries."""

from __future__ import annotations

from voltide.workload import book_queries, compare_queries, dashboard_queries, model_queries
from voltide.workload.base import Entry


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for module in (book_queries, model_queries, compare_queries, dashboard_queries):
        overlap = out.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"duplicate query names: {sorted(overlap)}")
        out |= module.QUERIES
    return out
