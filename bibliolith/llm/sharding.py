"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order.  A row's *fractional rank* is
its place in that order over the size of its source, and all rows sorted by fractional
rank interleave the sources in proportion.  Cutting that sequence into equal runs gives
shards whose counts differ by one at most and whose mixtures match the whole.

The law is ``rows``.  Copies of a text are ordinary rows here: keeping a group that may
hold a third of all rows in one shard would break the law.

Defined cases: a null text has size 1 (no bytes) and CRC 0; a null source is a source
of its own; rows that agree in id, size and CRC are interchangeable; with fewer rows
than shards, some shards are empty; an empty table gives no rows; a text of any length is
one row and only its size moves; ties in the seeded key go by id, CRC and size; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked_in_strata, shuffle_key, stratum


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cells: int = 1024,
) -> DataFrame:
    """One row a document: id, size, text_crc32, law, shard, slot, grown_shard.

    Shuffles: one of narrow rows to the cells of a source, one to the cells of the fractional rank.
    No text is shuffled, and no task holds more than a cell, whatever the largest source.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        stratum(F.col(source_col)).alias("_source"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        shuffle_key(seed, F.col(id_col)).alias("_key"),
    )
    ranked = ranked_in_strata(rows, "_source", "_key", ["_id", "text_crc32", "size"], cells)
    placed = ranked.withColumn("_f", (2 * F.col("before") + 1).cast("double") / (2 * F.col("stratum_rows")).cast("double"))
    placed = placed.withColumn("_slice", F.floor(F.col("_f") * cells).cast("int"))

    # Where each slice begins follows from the strata's sizes; the table has ``cells`` rows at most.
    counts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_slice",
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n0"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_slice").orderBy("_f", "_source", "_key", "_id", "text_crc32", "size")
    at = placed.withColumn("_r", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_slice")
    at = at.withColumn("_pos", (F.col("_n0") + F.col("_r")).cast("long"))
    at = at.withColumn("shard", F.expr(f"(_pos * {shards}) div _total").cast("int"))
    first = F.expr(f"(shard * _total + {shards} - 1) div {shards}")
    return at.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
