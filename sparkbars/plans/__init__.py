"""Registered queries over the given tables, one module per family of operators."""

from __future__ import annotations

import importlib

FAMILIES = ("indicators", "screens", "reports", "learning", "outcomes", "intake", "patterns")


def catalogue():
    from .base import REGISTRY
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return REGISTRY
