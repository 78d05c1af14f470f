"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

AREAS = ["sources", "retrieval", "relational", "profiling", "assessment", "paths", "models"]


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"lectern.plans.{area}")
