"""Importing this module registers every query."""

from linewarden.plans import calls, ledgers, live, quality, streams, tags  # noqa: F401
from linewarden.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
