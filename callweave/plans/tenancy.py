"""Every read belongs to one company."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TenantScopeError(ValueError):
    """A read without a company, or of another one."""


@dataclass(frozen=True)
class Tenant:
    company_id: int

    @property
    def collection(self) -> str:
        return f"kb_company_{self.company_id}"


def require(tenant: Tenant | None) -> Tenant:
    if tenant is None or tenant.company_id is None or tenant.company_id <= 0:
        raise TenantScopeError("a company is required")
    return tenant


def scoped(df: DataFrame, tenant: Tenant | None) -> DataFrame:
    """The company's rows.  On a table partitioned by company_id this prunes partitions."""
    return df.where(F.col("company_id") == require(tenant).company_id)


def resolve(auth_on: bool, role: str | None, own_company: int | None, header: int | None) -> int:
    """The company of a request: a super admin names it, anyone else has their own."""
    if not auth_on or role == "super_admin":
        if header is None:
            raise TenantScopeError("name a company")
        return header
    if own_company is None:
        raise TenantScopeError("the account has no company")
    if header is not None and header != own_company:
        raise PermissionError("another company's data")
    return own_company


# What a caller may filter by.
ALLOWED_FILTERS = ("language", "document_id", "source", "source_type", "page_number")


def clean_filters(filters: dict | None) -> tuple[dict, list[str]]:
    """Allowed filters with a value, and the names of all others."""
    kept = {k: v for k, v in (filters or {}).items() if k in ALLOWED_FILTERS and v is not None}
    return kept, sorted(set(filters or {}) - set(kept))


def predicate(filters: dict) -> Column:
    """Conjunction: a list means any of its values that are not None, and an empty one no condition.

    Absent integers count as -1 and absent strings as '', so those values match absence.
    """
    out = F.lit(True)
    for name, wanted in filters.items():
        values = [v for v in wanted if v is not None] if isinstance(wanted, (list, tuple, set)) else [wanted]
        if not values or values == [None]:
            continue
        absent = -1 if isinstance(values[0], int) else ""
        out = out & F.coalesce(F.col(name), F.lit(absent)).isin(values)
    return out
