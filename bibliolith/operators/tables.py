"""Previews of report tables: search, sort, page."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def search_text(table: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Rows of which some string column matches a pattern, in any case."""
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, StringType)]
    if not pattern or not texts:
        return table
    test = (lambda c: F.contains(F.lower(c), F.lit(pattern.lower()))) if literal else (lambda c: F.rlike(c, F.lit(f"(?i){pattern}")))
    return table.where(functools.reduce(operator.or_, [F.coalesce(test(_quoted(n)), F.lit(False)) for n in texts]))


def sort_by(table: DataFrame, column: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Text is sorted without regard to case."""
    key = F.lower(_quoted(column)) if isinstance(table.schema[column].dataType, StringType) else _quoted(column)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return table.orderBy(order, *([_quoted(tie)] if tie else []))


def finite(table: DataFrame) -> DataFrame:
    """NaN and infinities as nulls."""
    bad = [f.name for f in table.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    infinity = F.lit(float("inf"))
    return table.withColumns({n: F.when(~F.isnan(_quoted(n)) & (F.abs(_quoted(n)) != infinity), _quoted(n)) for n in bad})


def preview(
    table: DataFrame, search: str = "", sort: str | None = None, descending: bool = False, limit: int = 50, offset: int = 0, tie: str | None = None
) -> DataFrame:
    found = search_text(table, search)
    if sort:
        found = sort_by(found, sort, descending, tie)
    return finite(found.offset(offset).limit(limit))


def limit_by(table: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group; Spark prunes groups before the shuffle."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def dedup_by_first_key(table: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each first non-null key, the least by ``order`` (all columns, if none is given); rows without any
    key all stay.  The least row is an aggregate, so a key of any size is combined before it is shuffled."""
    key = F.coalesce(*[F.col(k) for k in keys])
    whole = F.struct(*[_quoted(c) for c in table.columns])
    first = F.min_by(whole, F.struct(*[_quoted(c) for c in (order or table.columns)]))
    named = table.where(key.isNotNull()).groupBy(key.alias("_key")).agg(first.alias("_row")).select("_row.*")
    return named.unionByName(table.where(key.isNull()))


def entity_search(dimension: DataFrame, text: str, by: str | None = None, limit: int = 20) -> DataFrame:
    """Entries whose name contains a text, the largest first."""
    found = dimension.where(F.contains(F.lower("display_name"), F.lit(text.strip().lower())))
    order = [F.col(by).desc()] if by else []
    return found.orderBy(*order, "display_name", "id").limit(limit)


def entity_counts(works: DataFrame, ids: str, names: str, text: str, limit: int = 20) -> DataFrame:
    """Works by (id, name) of an array-valued entity whose name contains a text; ids and names are aligned lists."""
    pairs = works.select(F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(names).alias("n"))).alias("p"))
    pairs = pairs.select(F.col("p.i").alias("id"), F.col("p.n").alias("display_name"))
    found = pairs.where(F.contains(F.lower("display_name"), F.lit(text.strip().lower())))
    counted = found.groupBy("id", "display_name").agg(F.count(F.lit(1)).alias("works"))
    return counted.orderBy(F.col("works").desc(), "id", "display_name").limit(limit)
