"""Registered queries over the given tables."""

from candrank.plans import core_queries, model_queries, run_queries, split_queries  # noqa: F401
from candrank.plans.registry import QUERIES

__all__ = ["QUERIES"]
