"""Registered queries: each pairs a Spark plan with an independent SQL statement."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "scan_queries",
    "product_queries",
    "filter_queries",
    "scene_queries",
    "match_queries",
    "composite_queries",
    "series_queries",
    "stats_queries",
    "scalar_queries",
    "import_queries",
    "raster_queries",
    "methane_queries",
    "learning_queries",
    "stream_queries",
)


def load_all() -> None:
    """Import every module of registered queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
