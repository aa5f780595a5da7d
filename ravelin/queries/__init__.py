"""Queries over the driver's tables: name -> (callable, SQL or None)."""

from __future__ import annotations


def every() -> dict:
    from ravelin.queries import analytics, graphs, ingest, matching, rules

    out: dict = {}
    for part in (rules, matching, analytics, graphs, ingest):
        for name, entry in part.QUERIES.items():
            if name in out:
                raise ValueError(f"{name} is registered twice")
            out[name] = entry
    return out
