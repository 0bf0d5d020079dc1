"""Year windows and how works fall into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Period = tuple[int, int]
FULL = "full"


def consecutive_windows(start: int, end: int, width: int, anchor: str = "end") -> list[Period]:
    """Adjoining windows of ``width`` years; the one at the far side of the anchor may be shorter."""
    if start > end or width < 1:
        return []
    if anchor == "start":
        return [(s, min(s + width - 1, end)) for s in range(start, end + 1, width)]
    return [(max(e - width + 1, start), e) for e in range(end, start - 1, -width)][::-1]


def sliding_windows(start: int, end: int, width: int) -> list[Period]:
    """A window for each start year; a single one if none fits."""
    if start > end or width < 1:
        return []
    return [(s, s + width - 1) for s in range(start, end - width + 2)] or [(start, end)]


def label(period: Period) -> str:
    return f"{period[0]}-{period[1]}"


def assign_all(works: DataFrame, periods: list[Period], full: bool = False) -> DataFrame:
    """A row for each window a work falls in (windows may overlap), named ``period``."""
    year = F.col("publication_year")
    inside = [F.when(year.between(s, e), F.lit(label((s, e)))) for s, e in periods]
    if full:
        inside.append(F.lit(FULL))
    return works.withColumn("period", F.explode(F.filter(F.array(*inside), lambda p: p.isNotNull())))


def assign_first(works: DataFrame, periods: list[Period]) -> DataFrame:
    """The first window only; works in none are dropped."""
    year, found = F.col("publication_year"), F.lit(None).cast("string")
    for s, e in reversed(periods):
        found = F.when(year.between(s, e), F.lit(label((s, e)))).otherwise(found)
    return works.withColumn("period", found).where("period is not null")
