"""All queries of the core and their SQL."""

from __future__ import annotations

from scanloom.plans import findings, general, packages, roundtrip, samples, texts

_MODULES = (general, findings, texts, packages, roundtrip, samples)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
