"""All queries of the engine and their DuckDB SQL, gathered from the query modules."""

from __future__ import annotations

from skycensus.plans import catalog_queries, evaluate_queries, grid_queries, list_queries, model_queries, observation_queries, orbit_queries  # noqa: F401, I001
from skycensus.plans import apparition_queries, file_queries, search_queries  # noqa: F401  their SQL builds on that of the modules above
from skycensus.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
