"""All queries of the core and their DuckDB counterparts."""

from __future__ import annotations

from ctxspark.plans import q_agent, q_pack, q_scan, q_stream, q_telemetry, q_text  # noqa: F401  (modules register their queries)
from ctxspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
