"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from gridloom.plans import candidate_queries, evaluation_queries, metric_queries, raster_queries, shape_queries, vector_queries  # noqa: F401  (they register themselves)
from gridloom.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "zonal_stats"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
