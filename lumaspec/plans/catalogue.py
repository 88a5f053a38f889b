"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import cubes, evaluation, learned, places, scenes, tables

_PARTS = (cubes, tables, learned, evaluation, scenes, places)


def queries() -> dict:
    return {n: q for p in _PARTS for n, q in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for p in _PARTS for n, q in p.SQL.items()}
