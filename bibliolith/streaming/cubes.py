"""Yearly cubes kept up to date from a stream of works (an extension).

Accumulators are additive, so each micro-batch appends its own sums and reading adds them up.
A batch writes under its own id and replaces it when it is repeated, which makes retries harmless.

``maintain`` takes each work as new.  ``maintain_corrected`` takes works that come again: it keeps the last state of each id,
and a batch appends what it adds less what the states it replaces had added.  Under its path lie

* ``deltas/batch=N`` and ``states/batch=N``: signed cells by year, and the works as few numbers, of batches not yet folded;
* ``cells-V``: cells folded up to batch V, and ``works-W``: states folded up to a batch W of V or before;
* ``done-V``: written when these are complete; readers take the greatest, so they see all of a folding or nothing.

Cells are folded each time.  States are when those not yet folded have grown as large as the folded ones, so a state is
rewritten as often as the whole doubles.

A batch looks up the batches before it alone, so a repeated one finds what it found before and replaces its own folders.  A
batch of up to ``MOST_SENT`` ids gives all tasks their hashes, so that states which don't come again stay where they lie; of
batches in which none comes again only ids are read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cubes
from ..operators.entities import MEASURED
from ..operators.indicators import narrow


MOST_SENT = 4_000_000


def maintain(stream: DataFrame, cube: str, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    def merge(batch: DataFrame, batch_id: int) -> None:
        cubes.build(batch, cube).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    rows = stream.select(*dict.fromkeys([*MEASURED, *cubes.CUBES[cube].values()]))
    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _entries(spark: SparkSession, pattern: str) -> list:
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [f.getPath() for f in found or []]


def folded_up_to(spark: SparkSession, path: str) -> int:
    """The last batch that the folded tables hold; -1 if there are none."""
    return max((int(p.getName().removeprefix("done-")) for p in _entries(spark, f"{path}/done-*")), default=-1)


def _states_up_to(spark: SparkSession, path: str) -> int:
    """The last batch whose states the folded ones hold; -1 if there are none."""
    upto = folded_up_to(spark, path)
    whole = (int(p.getParent().getName().removeprefix("works-")) for p in _entries(spark, f"{path}/works-*/_SUCCESS"))
    return max((v for v in whole if v <= upto), default=-1)


def _tables(spark: SparkSession, path: str, folded: str, single: str, before: int | None = None) -> DataFrame | None:
    """The folded table and what single batches hold beyond it (before one); nothing before the first batch."""
    upto = _states_up_to(spark, path) if folded == "works" else folded_up_to(spark, path)
    parts = [spark.read.parquet(f"{path}/{folded}-{upto}").withColumn("batch", F.lit(upto).cast("long"))] if upto >= 0 else []
    if _entries(spark, f"{path}/{single}/batch=*/_SUCCESS"):
        rows = spark.read.parquet(f"{path}/{single}").withColumn("batch", F.col("batch").cast("long")).where(F.col("batch") > upto)
        parts.append(rows if before is None else rows.where(F.col("batch") < before))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def _bytes(spark: SparkSession, paths: list) -> int:
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)


def _of(known: DataFrame, ids: DataFrame) -> DataFrame | None:
    """The rows of ``known`` whose id is one of ``ids``; none if no batch has any."""
    if ids.count() <= MOST_SENT:  # hashes let through a few others; the join by id does not
        sent = F.broadcast(ids.select(F.xxhash64("id").alias("_hash")))
        met = lambda rows: rows.join(sent, F.xxhash64(rows["id"]) == F.col("_hash"), "left_semi")
        # Ids alone are read of all batches, and states of those only that have some of the ids.
        batches = [r["batch"] for r in met(known.select("id", "batch")).select("batch").distinct().collect()]
        if not batches:
            return None
        known = met(known.where(F.col("batch").isin(batches)))
    return known.join(ids, "id", "left_semi")


def _last(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each id in an order; rows without an id are all kept."""
    first = Window.partitionBy("id", "_alone").orderBy(*order)
    alone = rows.withColumn("_alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    return alone.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_alone", "_place")


def _last_states(rows: DataFrame) -> DataFrame:
    return _last(rows.where("id is not null"), F.desc("batch")).drop("batch")


def _signed(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """What a batch adds, and the states that it replaces with a sign of -1; what is older than the known state is left out."""
    added = new.withColumn("_sign", F.lit(1))
    if old is None:
        return added
    rows = added.where("id is not null").unionByName(old.withColumn("_sign", F.lit(-1)))
    if "_version" in new.columns:
        last = F.max(F.struct("_version", "_sign")).over(Window.partitionBy("id"))
        rows = rows.withColumn("_last", last).where("_last._sign = 1").drop("_last")
    return rows.unionByName(added.where("id is null"))


def maintain_corrected(
    stream: DataFrame, cube: str, path: str, checkpoint: str, version: str | None = None, fold_every: int = 50, available_now: bool = True
) -> StreamingQuery:
    """Keep ``path`` equal to the cube of the last state of every work; ``read_corrected`` reads it.

    Of states of one id the later batch wins, within a batch any one; with a ``version`` column the greatest wins, and a
    state older than what is known is left out.  Works without an id can't come again: each counts.
    """
    columns = list(dict.fromkeys(["id", "publication_year", *cubes.CUBES[cube].values()]))
    # Made narrow before it is cut to batches: a batch reads all columns of its stream.
    rows = narrow(stream, *columns, *([F.col(version).alias("_version")] if version else []))

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [*([F.desc("_version")] if version else []), F.xxhash64(*batch.columns).desc()]
        new = _last(batch, *order).persist()  # read and brought together once
        known = _tables(spark, path, "works", "states", before=number)
        old = _of(known, new.where("id is not null").select("id")) if known is not None else None
        signed = _signed(new, _last_states(old) if old is not None else None)
        signed = signed if old is None else signed.persist()
        signed.where("_sign = 1").drop("_sign").write.mode("overwrite").parquet(f"{path}/states/batch={number}")
        # Years are folders of their own, so a reader of few years skips the others.
        delta = cubes.build_narrow(signed, cube, "_sign")
        delta.write.mode("overwrite").partitionBy("publication_year").parquet(f"{path}/deltas/batch={number}")
        signed.unpersist()
        new.unpersist()
        if number and number % fold_every == 0:
            fold(spark, cube, path, number)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_corrected(spark: SparkSession, cube: str, path: str) -> DataFrame:
    """The cube as of the last batch, with histograms."""
    return cubes.merge(_tables(spark, path, "cells", "deltas").drop("batch"), [*cubes.CUBES[cube], "publication_year"])


def fold(spark: SparkSession, cube: str, path: str, upto: int) -> None:
    """Put cells, and states once they have doubled, up to a batch into one table; tables before the last folded ones are deleted."""
    before, states_before = folded_up_to(spark, path), _states_up_to(spark, path)
    if upto <= before:
        return
    cells, states = (_tables(spark, path, f, s, before=upto + 1) for f, s in (("cells", "deltas"), ("works", "states")))
    merged = cubes.merge(cells.drop("batch"), [*cubes.CUBES[cube], "publication_year"])
    merged.write.mode("overwrite").partitionBy("publication_year").parquet(f"{path}/cells-{upto}")
    target = spark._jvm.org.apache.hadoop.fs.Path
    single = [p for p in _entries(spark, f"{path}/states/batch=*") if states_before < int(p.getName().removeprefix("batch=")) <= upto]
    if states_before < 0 or _bytes(spark, single) >= _bytes(spark, [target(f"{path}/works-{states_before}")]):
        _last_states(states).write.mode("overwrite").parquet(f"{path}/works-{upto}")
    done = target(f"{path}/done-{upto}")
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    files.create(done, True).close()  # from here on readers see the new tables
    for table, last in (("deltas/batch=", before), ("states/batch=", states_before), ("cells-", before), ("works-", states_before), ("done-", before)):
        for old in _entries(spark, f"{path}/{table}*"):
            if int(old.getName().replace("batch=", "").rsplit("-", 1)[-1]) < last:
                files.delete(old, True)
