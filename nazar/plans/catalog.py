"""Catalogue of every registered query (imports the query modules once)."""

from __future__ import annotations

import importlib

from nazar.plans.registry import REGISTRY, Query

_MODULES = ["q_labels", "q_text", "q_features", "q_metrics", "q_errors", "q_vectors", "q_ensemble", "q_sources", "q_models"]


def all_queries() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"nazar.plans.{m}")
    return dict(REGISTRY)
