"""The registered queries of the indicator engine, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports
from ..operators.entities import ENTITIES
from . import reference_sql as sql
from .testworks import works

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PERIODS = [(1995, 1996), (1997, 1998), (1999, 2000)]
SLIDING = [(1995, 1997), (1996, 1998), (1997, 1999)]


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


for _slug, _entity in ENTITIES.items():
    register(f"entity_{_slug}_full", lambda s, d, e=_entity: reports.full_table(works(s, d), e), sql.full(_slug))
    register(
        f"entity_{_slug}_periods",
        lambda s, d, e=_entity: reports.period_tables(works(s, d), e, PERIODS),
        sql.periods_table(_slug, PERIODS),
    )
    register(
        f"entity_{_slug}_matrix",
        lambda s, d, e=_entity: reports.matrix(works(s, d), e, PERIODS),
        sql.matrix(_slug, PERIODS, reports.MATRIX_METRICS),
    )
    register(f"entity_{_slug}_trend", lambda s, d, e=_entity: reports.trend_table(works(s, d), e), sql.trend(_slug))

from . import catalog_more  # noqa: E402,F401  registers the other operators
