"""One form of each identifier, applied on every way into a corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(column: Column) -> Column:
    """The last path segment: ids come bare and as URLs."""
    return F.element_at(F.split(F.trim(column), "/"), -1)


def doi_key(column: Column) -> Column:
    """Lower case, without a resolver's address."""
    return F.regexp_replace(F.lower(F.trim(column)), r"^https?://(dx\.)?doi\.org/", "")


def canonical_ids(values: list[str]) -> list[str]:
    """Distinct canonical ids in their first order."""
    return list(dict.fromkeys(v.strip().split("/")[-1] for v in values if v and v.strip()))
