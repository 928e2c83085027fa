"""Queries over the driver tables, each paired with its SQL check."""

from importlib import import_module
from importlib.util import find_spec

_MODULES = [
    "function_queries", "palette_queries", "raster_queries", "region_queries", "edit_queries", "sheet_queries",
    "ledger_queries", "project_queries", "grouping_queries", "legend_queries", "lattice_queries", "source_queries",
    "stream_queries", "flow_queries", "timeline_queries", "rollup_queries",
]


def load_all() -> None:
    for name in _MODULES:
        if find_spec(f"gridloom.plans.{name}"):
            import_module(f"gridloom.plans.{name}")
