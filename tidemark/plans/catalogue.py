"""Every query of the feature engine by name, and its SQL."""

from __future__ import annotations

from . import blob_queries, climate_queries, composed_queries, map_queries, mask_queries, mesh_queries, metric_queries, node_queries, track_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (node_queries, blob_queries, climate_queries, track_queries, metric_queries, mask_queries, map_queries, mesh_queries, composed_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
