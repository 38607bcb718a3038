"""Imports every module that registers queries."""

from driver import civic_queries, graph_queries, history_queries, product_queries, scan_queries, source_queries, stream_queries  # noqa: F401
