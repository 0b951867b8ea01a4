"""Where named queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import views as V
from .plans.tenancy import Tenant

TENANT = Tenant(3)
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    """Register a query; needs are the views that its SQL reads."""

    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = V.with_views(sql, *needs) if needs else sql
        return f

    return keep
