"""Pairs of institutions of a work, for works of any number of them.

The sorted names of a work are cut into blocks, and each pair of blocks is a row of its own that goes to any task; pairs are
made there.  Tables count the documents of pairs first and measure the pairs that the limit lets through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import MEASURED
from .indicators import indicator_table
from .reports import ROW_LIMIT, leading, ranked

BETWEEN = " --- "


def _blocks(works: DataFrame, carry: list[str], block: int, column: str) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.filter(column, lambda x: x != "")))
    last = F.floor((F.size("_names") - 1) / block).cast("int")
    upto = F.explode(F.sequence(F.lit(0), last))
    left = works.select(*carry, names.alias("_names")).where(F.size("_names") > 1).withColumn("_i", upto)
    both = left.withColumn("_j", F.explode(F.sequence(F.col("_i"), last)))
    part = lambda k: F.slice("_names", F.col(k) * block + 1, F.lit(block))
    cut = both.select(*carry, part("_i").alias("_a"), part("_j").alias("_b"), "_i", "_j")
    # Works of one pair of blocks stay where they are; the blocks of large ones are dealt anew.
    small = cut.where((F.col("_i") == 0) & (F.col("_j") == 0) & (F.size("_b") < block))
    large = cut.where((F.col("_i") > 0) | (F.col("_j") > 0) | (F.size("_b") >= block))
    return small.unionByName(large.repartition(F.xxhash64("_a", "_b")))


def institution_pairs(works: DataFrame, carry: list[str], block: int = 256, column: str = "institution_names") -> DataFrame:
    """``carry`` and ``a``, ``b``: a row for each unordered pair (a < b) of distinct names of a work; empty names have none."""
    rows = _blocks(works, carry, block, column).withColumn("a", F.explode("_a"))
    return rows.withColumn("b", F.explode("_b")).where("a < b").select(*carry, "a", "b")


def pair_table(works: DataFrame, min_docs: int = 1, limit: int = ROW_LIMIT, block: int = 256) -> DataFrame:
    """The indicator table of pairs, as ``reports.full_table`` of the entity has it."""
    pairs = institution_pairs(works, list(MEASURED), block)
    rows = pairs.select(*MEASURED, F.concat("a", F.lit(BETWEEN), "b").alias("name"))
    return ranked(indicator_table(leading(rows, limit, min_docs, spread=True), ["name"]), None, limit, min_docs)
