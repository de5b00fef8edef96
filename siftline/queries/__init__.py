"""Registered queries with their SQL."""

from siftline.queries import captures, events, funnel, items, pages, parsing, runs, schemas, scores
from siftline.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "captures", "events", "funnel", "items", "pages", "parsing", "runs", "schemas", "scores"]
