"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("metric_queries", "merchant_queries", "order_queries", "ingest_queries")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"bizdiag.plans.{name}"), attribute))
    return out


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return _collect("QUERIES")


def oracles() -> dict:
    """Name -> SQL."""
    return _collect("ORACLES")
