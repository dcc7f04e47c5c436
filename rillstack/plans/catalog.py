"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from rillstack.plans import array_queries, detection_queries, event_queries, frame_queries, further_queries, mask_queries, peak_queries, signal_queries, stack_queries, stream_queries, window_queries

_MODULES = [signal_queries, frame_queries, mask_queries, array_queries, event_queries, further_queries, detection_queries, peak_queries, window_queries, stack_queries, stream_queries]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
