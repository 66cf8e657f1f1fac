"""Collects the queries and oracle statements of the query modules."""

from __future__ import annotations

import importlib

MODULES = [f"voxloom.plans.{m}_queries" for m in ("interval", "relation", "text", "stat", "sequence", "batch", "scoring", "stream", "source", "chain")]


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        module = importlib.import_module(name)
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
