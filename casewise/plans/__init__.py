"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib

GROUPS = ["q_sources", "q_tables", "q_aggregates", "q_series", "q_models", "q_recommend"]


def load():
    """Import every query module and return the registry."""
    for name in GROUPS:
        importlib.import_module(f"casewise.plans.{name}")
    return importlib.import_module("casewise.plans.registry")
