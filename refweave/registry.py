"""Collects the queries and their SQL from the modules of refweave.plans."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("citing", "extraction", "field_codes", "resolving", "laying_out")


def _loaded():
    return [importlib.import_module(f"refweave.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _loaded() for k, s in m.ORACLES.items()}
