"""All registered queries."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("telemetry_queries", "scoring_queries", "signal_queries", "cluster_queries", "model_queries", "stream_queries", "file_queries")


def all_queries():
    out = {}
    for m in _MODULES:
        out.update(import_module(f"faultline.plans.{m}").QUERIES)
    return out
