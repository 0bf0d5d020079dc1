"""Report shapes: full and period tables, performance matrices, annual trends.

One aggregation over (entity, period) serves every shape of an entity: a work is multiplied by
its periods before the partial sums, and what is shuffled is already summed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import growth, half_even
from .entities import ENTITIES, MEASURED, WHOLE_CORPUS, Entity, by_entity
from .indicators import accumulate_narrow, from_accumulators, indicator_table, narrow
from .periods import FULL, Period, assign_all, label

ROW_LIMIT = 5000
MOST_SENT = 100_000  # names that every task is given
MATRIX_METRICS = {
    "docs": "num_documents",
    "cites": "times_cited",
    "impact": "cites_per_doc",
    "fwci": "fwci_avg",
    "top10": "pct_top_10",
    "diamond": "pct_oa_diamond",
    "international": "pct_international",
    "h": "h_index",
}


def ranked(table: DataFrame, by: list[str] | None = None, limit: int | None = ROW_LIMIT, min_docs: int = 1) -> DataFrame:
    """Rank by documents, ties by name; within groups, only ``limit`` rows of each are kept."""
    kept = table.where(F.col("num_documents") >= min_docs)
    order = [F.col("num_documents").desc(), F.col("name")]
    if not by and limit is not None:
        kept = kept.orderBy(*order).limit(limit)  # a distributed top-k before the single-task ranking
    window = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(window))
    return kept.where(F.col("rank") <= limit) if by and limit is not None else kept


def leading(rows: DataFrame, limit: int | None, min_docs: int = 1, spread: bool = False) -> DataFrame:
    """The rows of the names that ``ranked`` will keep, so that no others are measured.

    Their documents are counted first, by name alone.  Names that are ``spread`` (nearly each row has its own) are counted
    where they meet: partial counts would fill a task's memory and hardly shrink them.
    """
    if limit is None:
        return rows
    names = rows.select("name")
    counts = (names.repartition("name") if spread else names).groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs)
    kept = counts.orderBy(F.desc("_n"), "name").limit(limit).select("name")
    return rows.join(F.broadcast(kept) if limit <= MOST_SENT else kept, "name", "left_semi")


def full_table(works: DataFrame, entity: Entity, min_docs: int = 1, limit: int | None = ROW_LIMIT) -> DataFrame:
    rows = leading(by_entity(works, entity), limit, min_docs, entity.spread)
    return ranked(indicator_table(rows, ["name"]), None, limit, min_docs)


def period_table(works: DataFrame, entity: Entity, period: Period, min_docs: int = 1) -> DataFrame:
    return full_table(works.where(F.col("publication_year").between(*period)), entity, min_docs)


def period_tables(
    works: DataFrame, entity: Entity, periods: list[Period], min_docs: int = 1, limit: int | None = ROW_LIMIT, overlap: bool = True
) -> DataFrame:
    """The tables of all periods, told apart by ``period``.

    Each period is cut to ``limit`` by a distributed top-k of its own; ranking all of its rows would take one task.
    """
    tables = []
    for k, (start, end) in enumerate(periods):
        if (start, end) in periods[:k]:
            continue
        inside = works.where(F.col("publication_year").between(start, end))
        if not overlap:
            for s, e in periods[:k]:
                inside = inside.where(~F.col("publication_year").between(s, e))
        table = indicator_table(leading(by_entity(inside, entity), limit, min_docs, entity.spread), ["name"])
        tables.append(ranked(table.select(F.lit(label((start, end))).alias("period"), "*"), ["period"] if limit is None else None, limit, min_docs))
    return functools.reduce(DataFrame.unionByName, tables)


def trend_table(works: DataFrame, entity: Entity) -> DataFrame:
    """Names that are ``spread`` have nearly a row for each work, and all are kept: sums of them would move wider than the works."""
    if entity.spread:
        dated = narrow(works.where("publication_year > 0"), "publication_year", entity.key().alias("names"))
        rows = dated.select(F.explode("names").alias("name"), *[c for c in dated.columns if c != "names"]).where("name <> ''")
        # As many tasks as the input asks for: a fixed number would each hold more groups as it grows.
        partitions = max(int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * works.rdd.getNumPartitions())
        keys = ["name", "publication_year"]
        return from_accumulators(accumulate_narrow(rows, keys, partitions), keys)
    return indicator_table(by_entity(works, entity).where("publication_year > 0"), ["name", "publication_year"])


def baseline(works: DataFrame, period: Period | None = None) -> DataFrame:
    rows = works.where(F.col("publication_year").between(*period)) if period else works
    return indicator_table(by_entity(rows, ENTITIES["corpus"]), ["name"])


def corpus_trend(works: DataFrame) -> DataFrame:
    """Yearly indicators with the change of documents and citations against the year before that is present."""
    rows = indicator_table(works.select(*MEASURED).where("publication_year > 0"), ["publication_year"])
    along = Window.partitionBy().orderBy("publication_year")
    return rows.select(
        F.lit(WHOLE_CORPUS).alias("name"),
        "*",
        growth(F.col("num_documents"), F.lag("num_documents").over(along)).alias("docs_growth"),
        growth(F.col("times_cited"), F.lag("times_cited").over(along)).alias("cites_growth"),
    )


def consecutive_table(works: DataFrame, periods: list[Period]) -> DataFrame:
    """A row a period with changes: documents from nothing count as 100, other changes from nothing as null."""
    rows = indicator_table(assign_all(works.select(*MEASURED), periods), ["period"])
    along = Window.partitionBy().orderBy("period")
    docs, before = F.col("num_documents"), F.lag("num_documents").over(along)
    cites, cites_before = F.col("times_cited"), F.lag("times_cited").over(along)
    return rows.select(
        "*",
        F.when((before == 0) & (docs > 0), 100.0).otherwise(growth(docs, before)).alias("docs_change"),
        growth(cites, cites_before).alias("cites_change"),
        half_even(F.col("fwci_avg") - F.lag("fwci_avg").over(along), 2).alias("fwci_change"),
    )


def _change(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise(growth(now, before))


def matrix(works: DataFrame, entity: Entity, periods: list[Period], min_docs: int = 1, limit: int | None = ROW_LIMIT) -> DataFrame:
    """Totals and, for each period, eight indicators, with changes between neighbouring periods.

    Keyed by entity: the periods are pivoted by conditional aggregation over one (entity, period) table.
    """
    kept = leading(by_entity(works, entity), limit, min_docs, entity.spread)
    rows = indicator_table(assign_all(kept, periods, full=True), ["name", "period"])
    labels = [label(p) for p in periods]
    cells = [
        F.coalesce(F.max(F.when(F.col("period") == p, F.col(metric))), F.lit(0)).alias(f"{short}_{p}".replace("-", "_"))
        for p in labels
        for short, metric in MATRIX_METRICS.items()
    ]
    totals = [F.max(F.when(F.col("period") == FULL, F.col(m))).alias(m) for m in ("num_documents", "times_cited", "cites_per_doc", "h_index")]
    wide = rows.groupBy("name").agg(*totals, *cells)
    changes = []
    for a, b in zip(labels, labels[1:]):
        x, y = a.replace("-", "_"), b.replace("-", "_")
        changes.append(_change(F.col(f"docs_{y}"), F.col(f"docs_{x}")).alias(f"docs_change_{y}"))
        changes.append(_change(F.col(f"fwci_{y}"), F.col(f"fwci_{x}")).alias(f"fwci_change_{y}"))
    return ranked(wide.select("*", *changes), None, limit, min_docs)


def consolidated(tables: dict[str, DataFrame]) -> DataFrame:
    """All entities' tables under one another, with the entity first and missing columns null."""
    out = None
    for name, table in tables.items():
        named = table.select(F.lit(name).alias("entity"), "*")
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out
