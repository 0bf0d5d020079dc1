"""URL filters by a temporal list join.

A list changes over time: each dated line lists a host or domain with an action, or drops it.
The lines of an entry become validity intervals, and every capture is evaluated against the
entries that were active when it was fetched.  Among the active entries that match a capture,
its host or any parent domain, the most specific one decides.

This is an as-of join.  Intervals of one entry don't overlap, so a capture meets at most one
interval of each of its keys, and an equality join with a range condition is enough.  A host may
hold a third of all captures: captures are salted, and the list, which is small beside them, is
repeated for each salt.  All of it is DataFrame code; no Python runs on the executors.

Defined cases: a null or unparsable URL has no host, and a null fetch day has no active entry;
both are kept.  Several lines of one entry on one day count as the strongest of them, where
``drop`` beats ``allow`` and ``allow`` beats ``block``.  Repeated captures are each evaluated;
an empty list keeps everything; of entries that match a host the one with most labels decides,
so there are no ties; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
STRENGTH = ("block", "allow", "drop")


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def host_keys(host: Column) -> Column:
    """The host and its parent domains of two labels at least, as (labels, entry)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    keys = F.transform(starts, lambda i: F.struct((n - i + 1).alias("labels"), F.array_join(F.slice(labels, i, n), ".").alias("entry")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast(_KEYS)).otherwise(keys)


_KEYS = "array<struct<labels:int,entry:string>>"


def validity_intervals(lines: DataFrame) -> DataFrame:
    """``entry, action, valid_from, valid_to`` (open at the end) from dated lines ``entry, day, action``."""
    rank = F.array_position(F.array(*[F.lit(a) for a in STRENGTH]), F.col("action"))
    daily = (
        lines.where("entry is not null and day is not null and action is not null")
        .groupBy(F.lower("entry").alias("entry"), "day")
        .agg(F.max(F.struct(rank.alias("rank"), F.col("action").alias("action"))).alias("best"))
    )
    along = Window.partitionBy("entry").orderBy("day")
    return daily.select(
        "entry", F.col("best.action").alias("action"), F.col("day").alias("valid_from"), F.lead("day").over(along).alias("valid_to")
    ).where("action <> 'drop'")


def filter_captures(
    captures: DataFrame, lines: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched", salts: int = 16
) -> DataFrame:
    """One row a capture: id, host, the fetch day, the deciding entry and action (or null), kept."""
    rows = captures.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        url_host(F.col(url_col)).alias("_host"),
        F.col(day_col).alias("_day"),
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    keyed = salted.select("*", F.explode_outer(host_keys(F.col("_host"))).alias("_key"))
    intervals = validity_intervals(lines).select(
        F.col("entry"), "action", "valid_from", "valid_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    active = (
        (F.col("_key.entry") == F.col("entry"))
        & (F.col("_salt") == F.col("salt"))
        & (F.col("_day") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    )
    met = keyed.join(intervals, active, "left")
    decided = met.groupBy("_row", "_id", "_host", "_day").agg(
        F.max(F.when(F.col("entry").isNotNull(), F.struct(F.col("_key.labels").alias("labels"), "entry", "action"))).alias("best")
    )
    return decided.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_day").alias(day_col),
        F.col("best.entry").alias("entry"),
        F.col("best.action").alias("action"),
        (F.coalesce(F.col("best.action"), F.lit("allow")) != "block").alias("kept"),
    )
