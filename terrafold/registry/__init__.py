"""Named queries over the benchmark tables, each with an independent SQL statement where one exists."""

from terrafold.registry.core import QUERIES, SQL
from terrafold.registry import assignment, filters, geometry, joins, missing, models, profiles, sources  # noqa: F401  (they register)

__all__ = ["QUERIES", "SQL"]
