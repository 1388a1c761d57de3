"""All registered queries: importing a module of queries registers what it defines."""

from . import boxes, catalog, directory, etl, graph, ingest, labels, matching, records, search, sync  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
