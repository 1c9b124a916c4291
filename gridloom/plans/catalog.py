"""Imports every query module so that its queries are registered."""

import importlib

from .registry import ORACLES, QUERIES

MODULES = (
    "matrix",
    "validation",
    "derived",
    "assembly",
    "networks",
    "iteration",
    "dispatch",
    "runlogs",
    "statistics",
    "ledgers",
    "campaigns",
    "fingerprints",
    "annotation",
    "files",
)
for _name in MODULES:
    importlib.import_module(f".{_name}_queries", __package__)

__all__ = ["ORACLES", "QUERIES"]
