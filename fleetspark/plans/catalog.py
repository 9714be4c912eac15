"""All registered queries."""

from fleetspark.plans import fleet_queries, ingest_queries, plant_queries, report_queries, rule_queries  # noqa: F401
from fleetspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
