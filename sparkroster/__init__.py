"""Inventories, keyed tables, run data and saved queries on Spark."""

__version__ = "0.1.0"
