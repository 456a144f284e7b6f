"""All registered queries."""

from checks import council_queries, flow_queries, licence_queries, page_queries, report_queries
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "council_queries", "flow_queries", "licence_queries", "page_queries", "report_queries"]
