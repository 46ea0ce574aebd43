"""All catalog queries, imported for their registration side effect."""

from __future__ import annotations

from tidepool.plans import governance, identity, lakehouse, models, operations, profiling, quality, retrieval, watch  # noqa: F401
from tidepool.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
