"""Yearly cubes: the indicators' accumulators, kept by key and year and summed on reading.

The h-index is no sum, but the histogram of citation counts is: a cell may carry it as a sorted array of (cites, works),
works without citations left out.  Cells merge by adding the works of each count, so any set of years and keys gives the exact
h-index from the cube alone.  A cell's array has as many entries as its works have distinct counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .entities import MEASURED
from .indicators import accumulators, from_accumulators, indicators, narrow, narrow_accumulators

CUBES = {
    "countries": {"country": "country_codes"},
    "topics": {"topic": "topic_id"},
    "institutions": {"institution": "institution_names"},
    "sources": {"source": "source_id"},
    "topic_country": {"topic": "topic_id", "country": "country_codes"},
}
LISTS = {"country_codes", "institution_names"}


def _exploded(rows: DataFrame, cube: str) -> DataFrame:
    keys = CUBES[cube]
    for name, column in keys.items():
        rows = rows.withColumn(name, F.explode(F.array_distinct(column)) if column in LISTS else F.col(column))
    return rows.where(" and ".join(f"{name} <> ''" for name in keys))


def keyed(works: DataFrame, cube: str) -> DataFrame:
    """A row for each work and key of the cube, with what the accumulators need."""
    columns = [c for c in CUBES[cube].values() if c not in MEASURED]
    return _exploded(works.where("publication_year > 0").select(*MEASURED, *dict.fromkeys(columns)), cube)


def build(works: DataFrame, cube: str, histogram: bool = False) -> DataFrame:
    """One row a key and year; with ``histogram`` also ``citations``, from which the h-index of any union is read."""
    if not histogram:
        return keyed(works, cube).groupBy(*CUBES[cube], "publication_year").agg(*[c.alias(n) for n, c in accumulators().items()])
    return build_narrow(narrow(works, "publication_year", *CUBES[cube].values()), cube)


def build_narrow(works: DataFrame, cube: str, sign: str | None = None) -> DataFrame:
    """The cube with histograms of ``narrow`` works, which are told what they count for before they are multiplied.

    With a column ``sign``, works of -1 are taken away.
    """
    cell, by = [*CUBES[cube], "publication_year"], F.col(sign) if sign else None
    rows = _exploded(works.where("publication_year > 0"), cube)
    # Sums by cell are wide but few; counts by cell and citations are many, so these move without the sums.
    totals = rows.groupBy(*cell).agg(*[c.alias(n) for n, c in narrow_accumulators(by).items()])
    by_count = rows.groupBy(*cell, F.col("cited_by_count").alias("cites")).agg((F.sum(by) if sign else F.count(F.lit(1))).alias("works"))
    entry = F.when((F.col("cites") > 0) & (F.col("works") != 0), F.struct("cites", "works"))
    return totals.join(by_count.groupBy(*cell).agg(F.array_sort(F.collect_list(entry)).alias("citations")), cell)


def merge(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with histograms added up by ``keys``; signed ones cancel, and what has no works left is gone."""
    sums = cells.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in accumulators()]).where("doc_count <> 0")
    counts = cells.select(*keys, F.inline("citations")).groupBy(*keys, "cites").agg(F.sum("works").alias("works")).where("works <> 0")
    lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cites", "works"))).alias("citations"))
    none = F.array().cast("array<struct<cites:bigint,works:bigint>>")
    return sums.join(lists, keys, "left").withColumn("citations", F.coalesce("citations", none))


def write(cube: DataFrame, path: str) -> None:
    """Replaces the years that ``cube`` has and leaves the others, so a year can be loaded again."""
    cube.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("publication_year").parquet(path)


def rollup(cube: DataFrame, keys: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Additive indicators of a year range from any cube alone (``report`` has all); the year filter prunes its folders."""
    rows = cube.where(F.col("publication_year").between(*years)) if years else cube
    sums = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in accumulators()])
    return sums.select(*keys, *[c.alias(n) for n, c in indicators().items() if n != "h_index"])


def report(cube: DataFrame, keys: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """All thirty indicators of a year range from a cube with histograms, the h-index among them."""
    rows = cube.where(F.col("publication_year").between(*years)) if years else cube
    sums = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in accumulators()]).where("doc_count <> 0")
    entries = rows.select(*keys, F.inline("citations"))  # of cells, so a key has few: they move once, to their key
    counts = (entries.repartition(*keys) if keys else entries).groupBy(*keys, "cites").agg(F.sum("works").alias("works"))
    reached = F.sum("works").over(Window.partitionBy(*keys).orderBy(F.desc("cites")))
    placed = counts.withColumn("_h", F.least("cites", reached)).groupBy(*keys).agg(F.max("_h").alias("h_index"))
    return from_accumulators(sums.join(placed, keys, "left").na.fill(0, ["h_index"]), keys)


def share_of_total(cube: DataFrame, key: str) -> DataFrame:
    """Documents of each key over those of the cube."""
    sums = cube.groupBy(key).agg(F.sum("doc_count").alias("docs"))
    total = cube.agg(F.sum("doc_count").alias("total"))
    return sums.join(F.broadcast(total)).select(key, "docs", ratio(F.col("docs"), F.col("total"), 4, 100.0).alias("share_pct"))
