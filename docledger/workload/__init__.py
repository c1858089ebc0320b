"""Importing the package registers every query."""

from importlib import import_module

from docledger.workload.registry import ORACLES, QUERIES

MODULES = ("q_assemble", "q_normalize", "q_geometry", "q_index", "q_metrics", "q_align", "q_runs", "q_sources")

for _module in MODULES:
    import_module(f"docledger.workload.{_module}")

__all__ = ["ORACLES", "QUERIES"]
