"""Query catalog: name to builder, name to oracle SQL."""

from . import books, captures, exports, integrity, observations, outstandings, reads, rules, sinks, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
