"""The registered queries over the given tables, with their SQL twins."""

from registry.base import ORACLES, QUERIES  # noqa: F401
from registry import (  # noqa: F401
    dependency_queries, evaluation_queries, history_queries, ingest_queries, quality_queries,
    report_queries, rescan_queries, rule_queries, score_queries, stream_queries,
)
