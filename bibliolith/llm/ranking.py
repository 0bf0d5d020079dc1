"""Exact ranks and running sums inside strata of any size, without a task per stratum.

A stratum (a source, say) may hold a third of all rows.  Rows get a seeded 32-bit
shuffle key, equal key ranges are *cells* of a stratum, and only cells are windowed;
what precedes a cell comes from a table with one row per stratum and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_SPACE = 1 << 32


def shuffle_key(seed: int, column: Column) -> Column:
    """A 32-bit key from MD5 of ``seed:column``, so that SQL engines agree on it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def stratum(column: Column) -> Column:
    """A non-null, collision-free form of a nullable stratum column."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def ranked_in_strata(
    df: DataFrame, stratum_col: str, key_col: str, tie_break: list[str], cells: int, weight: Column | None = None, attach: DataFrame | None = None
) -> DataFrame:
    """Adds ``before`` (rows of the stratum that precede, in key and tie order), ``stratum_rows`` and,
    with ``weight``, ``weight_before`` and ``stratum_weight``.

    ``attach``: a table with one row a stratum, whose columns are added too.  It joins the table of cells,
    not the rows, so that a large stratum meets no single task.

    The order is by key, then by ``tie_break``; rows equal in all of these are interchangeable.
    """
    weighed = F.lit(0).cast("long") if weight is None else weight
    df = df.withColumn("_w", weighed).withColumn("_cell", F.floor(F.col(key_col) * cells / KEY_SPACE).cast("int"))
    sizes = df.groupBy(stratum_col, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    along = Window.partitionBy(stratum_col).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum_col)
    offsets = sizes.select(
        stratum_col,
        "_cell",
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_s0"),
        F.sum("_n").over(whole).alias("stratum_rows"),
        F.sum("_s").over(whole).alias("stratum_weight"),
    )
    if attach is not None:
        offsets = offsets.join(attach, stratum_col)
    inside = Window.partitionBy(stratum_col, "_cell").orderBy(key_col, *tie_break)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_r", F.row_number().over(inside) - 1).withColumn(
        "_sw", F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    )
    out = ranked.join(offsets, [stratum_col, "_cell"])
    out = out.withColumn("before", F.col("_n0") + F.col("_r"))
    if weight is not None:
        out = out.withColumn("weight_before", F.col("_s0") + F.col("_sw"))
    else:
        out = out.drop("stratum_weight")
    return out.drop("_w", "_cell", "_n0", "_s0", "_r", "_sw")
