"""Registered queries of the library and their SQL twins."""

from . import decisions, evaluation, graph, retrieval, security, stores, text, tree  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
