"""Registered queries over the driver tables, each beside the SQL it must equal."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

from fieldframe.plans import registry

MODULES = (
    "climate_queries",
    "clean_queries",
    "panel_queries",
    "grid_queries",
    "model_queries",
    "quality_queries",
    "crosswalk_queries",
    "text_queries",
)


def load() -> SimpleNamespace:
    """Import every query module and return the filled registry."""
    for module in MODULES:
        importlib.import_module(f"fieldframe.plans.{module}")
    return SimpleNamespace(queries=registry.QUERIES, oracles=registry.ORACLES)
