"""Queries over the standard tables, one for each operator, with their SQL."""

from sparkprep.plans import array_queries, batch_queries, builder_queries, chat_queries, example_queries, loader_queries, metric_queries, record_queries, sampling_queries, source_queries
from sparkprep.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "array_queries", "batch_queries", "builder_queries", "chat_queries", "example_queries", "loader_queries", "metric_queries", "record_queries", "sampling_queries", "source_queries"]
