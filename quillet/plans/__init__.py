"""Registered queries with their DuckDB SQL."""

from quillet.plans import corpus_queries, store_queries, stored_queries, text_queries  # noqa: F401  registers
from quillet.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
