"""All queries of the tracking engine and their SQL."""

from trailmark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
