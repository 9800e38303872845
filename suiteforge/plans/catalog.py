"""Imports every query module so their ``register`` calls run; exposes the registry."""

from . import eval_queries, flow_queries, matrix_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
