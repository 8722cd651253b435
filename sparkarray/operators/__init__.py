"""Operators on arrays by name; each module lists its own in ``METHODS``."""

from __future__ import annotations

from importlib import import_module

MODULES = ("reductions", "ordering", "scans", "hist", "indexing", "shaping", "products", "linalg", "signal", "misc", "tasks")
_methods: dict = {}


def method(name: str):
    if not _methods:
        for m in MODULES:
            _methods.update(import_module(f"sparkarray.operators.{m}").METHODS)
    return _methods.get(name)
