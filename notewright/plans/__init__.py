"""All registered queries, and their SQL."""

from notewright.plans import stored, viewer
from notewright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "stored", "viewer"]
