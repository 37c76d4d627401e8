"""All registered queries."""

from __future__ import annotations

from ledgerline.plans import (  # noqa: F401
    join_queries,
    log_queries,
    report_queries,
    run_queries,
    stream_queries,
)
from ledgerline.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
