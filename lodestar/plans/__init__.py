"""Query plans over the provided tables, one module a workload family."""

from __future__ import annotations

import importlib

FAMILIES = ("business", "questions", "monitoring", "knowledge", "scoring", "resampled", "answers", "catalogue", "intake")


def load_queries() -> dict:
    """All registered queries, in order of registration."""
    for family in FAMILIES:
        importlib.import_module(f"lodestar.plans.{family}")
    from lodestar.registry import QUERIES

    return QUERIES
