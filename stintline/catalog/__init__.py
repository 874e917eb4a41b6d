"""Named queries over the driver tables, each next to its DuckDB statement."""

import importlib

MODULES = ("strategy", "season", "record", "weekend", "telemetry", "geometry", "model", "feeds")


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"stintline.catalog.{name}")
    return importlib.import_module("stintline.catalog.registry")
