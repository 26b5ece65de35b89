"""All registered queries."""

from hexweave.plans import catalogs, cells, filters, joins, measures, places, pyramids, scans, tiles  # noqa: F401
from hexweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
