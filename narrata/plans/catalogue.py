"""The catalogue of named queries with their DuckDB oracles."""

from __future__ import annotations

from . import extracts, registry, scoring, star, streams, temporal, texts  # noqa: F401  each module registers its queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
