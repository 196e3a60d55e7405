"""All registered queries."""

from tracewell.plans.registry import ORACLE, QUERIES
from tracewell.plans import queries_alerts, queries_graph, queries_io, queries_ledger, queries_models, queries_read, queries_stream, queries_wallet  # noqa: F401

__all__ = ["QUERIES", "ORACLE"]
