"""All queries of the core engine with their SQL counterparts."""

from __future__ import annotations

from tessera.plans.catalog import QUERIES
from tessera.plans.oracles import ORACLES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
