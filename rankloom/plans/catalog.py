"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ("figure_data", "group_stats", "merged", "rankings", "text_features", "shaping", "rated", "scored", "sources_and_vectors", "stored_scorers")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"rankloom.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return dict(ORACLES)
