"""All registered queries."""

from checks import gold_queries, report_queries, serving_queries, silver_queries, stored_queries, stream_queries  # noqa: F401 - registers on import
from checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
