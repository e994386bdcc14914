"""All registered queries."""

from __future__ import annotations

from heirloom.plans import (  # noqa: F401
    job_queries,
    memory_queries,
    registry_queries,
    session_queries,
    stream_queries,
)
from heirloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
