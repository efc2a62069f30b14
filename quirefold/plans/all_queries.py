"""Imports every query module so that the registry is complete."""

from quirefold.plans import answer_queries, library_queries, search_queries, source_queries  # noqa: F401
from quirefold.plans.registry import ORACLES, QUERIES  # noqa: F401
