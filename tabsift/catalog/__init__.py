"""Runnable queries over the driver tables; importing the package fills the registry."""

from tabsift.catalog import analysing, converting, filtering, streaming, usage  # noqa: F401
from tabsift.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
