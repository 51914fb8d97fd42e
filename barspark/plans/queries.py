"""All registered queries of the library and their SQL."""

from __future__ import annotations

from barspark.plans import decision_queries, indicator_queries, operator_queries, stream_queries

QUERIES = {**operator_queries.QUERIES, **indicator_queries.QUERIES, **decision_queries.QUERIES, **stream_queries.QUERIES}
ORACLES = {**operator_queries.ORACLES, **indicator_queries.ORACLES, **decision_queries.ORACLES, **stream_queries.ORACLES}
