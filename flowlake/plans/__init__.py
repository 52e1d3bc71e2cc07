"""Registered queries: each runs an operator over the given tables, with its SQL twin if one exists."""

from __future__ import annotations

import importlib

from flowlake.plans.registry import ORACLES, QUERIES

_FAMILIES = ("splitting", "cleaning", "profiling", "evaluation", "modelling", "boosted", "transfer")


def load_all() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"flowlake.plans.{family}")


__all__ = ["ORACLES", "QUERIES", "load_all"]
