"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib

_MODULES = ("q_stats", "q_tx", "q_rules", "q_graph", "q_alerts", "q_reports", "q_stream")


def load():
    """The registry with all query modules imported."""
    for name in _MODULES:
        importlib.import_module(f"flowlens.workload.{name}")
    return importlib.import_module("flowlens.workload.registry")
