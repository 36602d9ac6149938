"""Bindings of the operators to the sample tables, each with its SQL counterpart."""
from __future__ import annotations

import importlib

FAMILIES = ("intake", "auditing", "shift", "predict", "grids", "replicates")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"driftgauge.plans.{family}")


def all_queries() -> dict:
    from driftgauge.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    from driftgauge.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
