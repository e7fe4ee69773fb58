"""Queries over the given tables."""

from sparkroster.catalog import changes, entries, functions, inventory, runs, saved  # noqa: F401
from sparkroster.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
