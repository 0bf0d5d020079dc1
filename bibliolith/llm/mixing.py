"""Mixing sources to target weights by capped water-filling.

Targets share the whole size by weight.  A source that would be repeated beyond the
maximum of epochs is clamped there, and its excess goes to the others by weight, again
until none is above.  The fixed point is reached in closed form: with sources sorted by
``cap / weight``, a prefix is clamped and one level holds for the rest.

Each source is then repeated ``target / size`` times: whole repetitions of every
document, and one more of those that come first in a seeded order, as far as the
fraction reaches.  The document that straddles the end is taken if the greater part of
it lies within, so a source misses its target by less than one document.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is
a source of its own, sorted last; an all-empty source has target 0; if no mix is
feasible (no words at all), every target is 0.  Repeated rows are each mixed; ties in the
seeded order go by id, size and CRC; a text of any length is one row; an empty table gives no
rows; other columns than those in ``keep`` are ignored, and none clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked_in_strata, shuffle_key, stratum
from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``_source, source_size, weight`` to targets.  One row a source: a table of sources, never of documents."""
    # Null (coded as the empty string) comes last, the others by code point.
    by_name = Window.orderBy(F.col("_source") == "", "_source")
    weighed = sizes.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1),
    )
    cap = F.col("source_size") * max_epochs
    by_level = Window.orderBy(cap.cast("double") / F.col("weight"), "_source")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    prefix = weighed.select(
        "*",
        F.coalesce(F.sum(cap).over(upto), F.lit(0)).alias("_clamped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("_left"),
        F.sum("source_size").over(whole).alias("_total"),
        F.row_number().over(by_level).alias("_k"),
    )
    # The level if exactly the sources before this one are clamped; it holds from the first one whose cap it respects.
    level = (F.col("_total") - F.col("_clamped")).cast("double") / F.col("_left").cast("double")
    fits = level * F.col("weight") <= cap.cast("double")
    first = F.min(F.when(fits, F.struct("_k", level.alias("level")))).over(whole)
    return prefix.withColumn("_first", first).select(
        "_source",
        "source_size",
        "weight",
        F.when(F.col("_first").isNull() | (F.col("_k") < F.col("_first._k")), cap.cast("double"))
        .otherwise(F.col("_first.level") * F.col("weight"))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    max_epochs: int = 3,
    seed: int = 7,
    weights: tuple[int, ...] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cells: int = 1024,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: id, size, source_size, target, repetitions, taken (and the columns in ``keep``).

    Only ``keep`` rides along; a source of any size is ranked by cells (see ranking).
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        stratum(F.col(source_col)).alias("_source"),
        word_count(F.col(text_col)).alias("size"),
        shuffle_key(seed, F.col(id_col)).alias("_key"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("_crc"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    if not keep:  # the words are counted once; rows that carry texts are not written again
        rows = Scratch(docs.sparkSession).write(rows)
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, max_epochs, weights).withColumnRenamed("source_size", "_source_size")
    ranked = ranked_in_strata(rows, "_source", "_key", ["_id", "size", "_crc"], cells, F.col("size"), targets)
    # target = whole * source_size + extra, and ``extra`` words come from the front of the seeded order.
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("target") / F.col("_source_size"))).otherwise(0)
    out = (
        ranked.withColumnRenamed("stratum_weight", "source_size")
        .withColumn("_whole", whole.cast("long"))
        .withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    )
    inside = (F.col("weight_before") * 2 + F.col("size")).cast("double") <= F.col("_extra") * 2
    times = F.when(F.col("size") == 0, 0).otherwise(
        F.least(F.col("_whole") + F.when(inside & (F.col("_extra") > 0), 1).otherwise(0), F.lit(max_epochs))
    )
    return out.withColumn("repetitions", times.cast("long")).select(
        F.col("_id").alias(id_col),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        "repetitions",
        (F.col("repetitions") * F.col("size")).cast("long").alias("taken"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
