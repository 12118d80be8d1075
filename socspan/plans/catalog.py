"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import entity_queries, feature_queries, score_queries, signal_queries, view_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (view_queries, entity_queries, signal_queries, score_queries, feature_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
