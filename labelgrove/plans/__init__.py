"""Composed plans and the registered queries."""

from __future__ import annotations

import importlib

QUERY_MODULES = ("metric_queries", "label_queries", "split_queries", "run_queries", "resample_queries", "fit_queries", "report_queries",
                 "library_queries", "stream_queries", "clip_queries", "source_queries",
                 "function_queries")


def all_queries():
    """(name -> callable, name -> SQL) of every registered query."""
    for module in QUERY_MODULES:
        importlib.import_module(f"labelgrove.plans.{module}")
    from labelgrove.plans.catalog import ORACLES, QUERIES
    return QUERIES, ORACLES
