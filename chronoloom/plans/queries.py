"""All registered queries of the library proper."""

from __future__ import annotations

from . import fold_queries, interval_queries, mora_queries, refine_queries, segment_queries, source_queries, text_line_queries, text_queries  # noqa: F401  they register themselves
from .registry import QUERIES, TWINS


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
