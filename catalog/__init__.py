"""Registered queries: each operator over the given tables, with equivalent SQL where there is one."""

from .registry import ORACLES, QUERIES
from . import entry, packages, files, tokens, scoring, joins, stats, routing, training, events, stores  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
