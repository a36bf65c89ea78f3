"""The registered queries of the engine's own operators and their SQL."""

from tidemark.plans import checks, features, reports, sources  # noqa: F401  (they register their queries)
from tidemark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
