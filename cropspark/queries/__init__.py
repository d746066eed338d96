"""Registered queries with their oracle SQL, and the tables they run on."""

from __future__ import annotations

from cropspark.queries import cohorts, jobs, learned, ranking, scalars, scans, streams
from cropspark.queries.domain import Domain

MODULES = [scalars, scans, cohorts, jobs, ranking, streams, learned]


def registry() -> dict:
    out = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = entry
    return out


def queries() -> dict:
    def bind(build):
        return lambda spark, folder: build(Domain(spark, folder))

    return {name: bind(entry[0]) for name, entry in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for name, entry in registry().items() if entry[1] is not None}
