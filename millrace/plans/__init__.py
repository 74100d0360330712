"""Queries over the standard tables, each with its SQL twin."""

from . import delivery, logs, orders, realtime, routing, state  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
