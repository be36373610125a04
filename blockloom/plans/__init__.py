"""Views and registered queries; importing any of them registers all."""

from . import body_queries, chain_queries, history_queries, lookup_queries, pool_queries, stream_queries, tool_queries, trace_queries  # noqa: F401
