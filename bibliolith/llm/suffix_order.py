"""The order of all suffixes of a table's texts, by rounds over the difference cover {1, 2} modulo 3.

A round sorts the triples at two of three positions over the partitions and numbers the distinct ones by prefix sums; if
some are equal, the string of these names is sorted by the same rounds.  The other suffixes are then merged in: each is
one letter before a sampled suffix and two before another, so two sorts, by a letter and a rank and by two letters and
a rank, say how many sampled suffixes of either kind stand before it.  Neighbours in the final order are compared by
their prefixes.

``byte_repeats`` gives the same rows with far less work, since it needs no order beyond the length of a string; this
form also gives the order itself.  Every round writes its tables, so a lost executor costs one step.

Defined cases: a null text is empty; equal texts, repeated rows and null ids are rows of their own; an order among
equal suffixes of different texts comes from what follows in the table, and doesn't change what repeats; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import partitions_for
from .store import Scratch
from .textkit import byte_rolling, runs, text_buffers

# A string of at most this many names is sorted in one task.
ALONE = 200_000


def _along(keys: list[str], flag: str):
    """Running numbers of a sorted partition: its distinct keys, its rows, and its flagged rows before each."""

    def run(batches):
        part, last, dense, place, flagged = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.stack([np.asarray(batch.column(c)) for c in keys])
            new = np.ones(n, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
            new[0] = last is None or bool((key[:, 0] != last).any())
            last = key[:, -1].copy()
            marks = np.asarray(batch.column(flag))
            numbers = dense + np.cumsum(new), place + 1 + np.arange(n), flagged + np.cumsum(marks) - marks
            dense, place, flagged = int(numbers[0][-1]), place + n, flagged + int(marks.sum())
            arrays = [*batch.columns, pa.array(np.full(n, part, np.int64)), *[pa.array(x.astype(np.int64)) for x in numbers]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_part", "dense", "place", "flagged"])

    return run


def ordered(rows: DataFrame, by: list[str], keys: list[str], scratch: Scratch, parts: int, flag: Column | None = None) -> tuple[DataFrame, int]:
    """``rows`` (long columns) sorted over the partitions with ``dense`` (number of the run of equal ``keys``), ``place`` (both
    from 1) and ``flagged`` (flagged rows before); and the number of runs.

    ``by`` ends with a column that is unique, so a frequent key is cut over partitions like any other stretch.
    """
    marked = rows.withColumn("_flag", F.lit(0).cast("long") if flag is None else flag.cast("long"))
    dealt = marked.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    schema = ", ".join(f"{c} long" for c in [*marked.columns, "_part", "dense", "place", "flagged"])
    table = scratch.write(dealt.mapInArrow(_along(keys, "_flag"), schema))
    key = F.struct(*keys)
    # One row a partition.
    ends = table.groupBy("_part").agg(
        F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last"),
        F.max("dense").alias("d"), F.count(F.lit(1)).alias("p"), F.sum("_flag").alias("f"),
    )
    line = Window.orderBy("_part")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce((F.col("first") == F.lag("last").over(line)).cast("long"), F.lit(0))
    sums = ends.withColumn("goes_on", goes_on).select(
        "_part",
        (F.coalesce(F.sum("d").over(before), F.lit(0)) - F.sum("goes_on").over(line)).alias("_d"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "pf"],
        F.col("d"),
    )
    sums = scratch.write(sums.coalesce(1))
    runs_found = sums.agg(F.max(F.col("_d") + F.col("d"))).first()[0] or 0
    numbered = table.join(F.broadcast(sums.drop("d")), "_part").select(
        *rows.columns, (F.col("dense") + F.col("_d")).alias("dense"), (F.col("place") + F.col("_p")).alias("place"),
        (F.col("flagged") + F.col("_f")).alias("flagged"), F.col("_flag"),
    )
    return numbered, runs_found


def _with_next(rows: DataFrame, columns: list[str], block: int = 1 << 16) -> DataFrame:
    """``rows`` at all positions ``pos``, with the columns of the next two (``name1``, ``name2``), zero beyond the end.

    The string is cut to blocks; the first two rows of one are also read by the block before.
    """
    own = F.floor(F.col("pos") / block)
    blocks = F.when((F.col("pos") % block < 2) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    line = Window.partitionBy("_block").orderBy("pos")
    nexts = [F.coalesce(F.lead(c, k).over(line), F.lit(0)).alias(f"{c}{k}") for c in columns for k in (1, 2)]
    cut = rows.withColumn("_block", F.explode(blocks))
    return cut.select("pos", *columns, *nexts, "_block").where(F.col("_block") == own).drop("_block")


def _alone(table: pd.DataFrame) -> pd.DataFrame:
    table = table.sort_values("pos")
    rank = np.unique(table["name"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return pd.DataFrame({"pos": table["pos"].to_numpy(), "rank": rank + 1})


def suffix_ranks(string: DataFrame, n: int, scratch: Scratch, parts: int, alone: int = ALONE) -> DataFrame:
    """``pos, rank`` (1 to n) of all suffixes of ``string`` (pos 0 to n - 1, name from 1 on)."""
    if n <= max(alone, 3):
        return string.groupBy().applyInPandas(_alone, "pos long, rank long")
    spark = string.sparkSession
    # The names of the first residue end with a triple that has a zero, so that no comparison runs into the second.
    more = int(n % 3 == 1)
    padded = string.unionAll(spark.range(n, n + 1).select(F.col("id").alias("pos"), F.lit(0).cast("long"))) if more else string
    residue, third = F.col("pos") % 3, F.floor(F.col("pos") / 3)
    triples = _with_next(padded, ["name"]).where(residue != 0)
    names = ["name", "name1", "name2"]
    named, distinct = ordered(triples, [*names, "pos"], names, scratch, parts)
    ones, twos = (n + more + 1) // 3, (n + more) // 3
    if distinct == ones + twos:
        ranks = named.select("pos", F.col("dense").alias("rank"))
    else:
        inner = named.select(F.when(residue == 1, third).otherwise(third + ones).alias("pos"), F.col("dense").alias("name"))
        below = suffix_ranks(inner, ones + twos, scratch, parts, alone)
        ranks = below.select(F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2).alias("pos"), "rank")
    zero = F.lit(0).cast("long")
    both = padded.select("pos", "name", zero.alias("rank")).unionAll(ranks.select("pos", zero.alias("name"), "rank"))
    around = _with_next(both.groupBy("pos").agg(F.max("name").alias("name"), F.max("rank").alias("rank")), ["name", "rank"])
    around = scratch.write(around.where(F.col("pos") < n))
    rest = residue == 0
    first, _ = ordered(around.where(residue != 2).select("pos", "rank", "name", "rank1"), ["name", "rank1", "pos"], ["name"], scratch, parts, rest)
    second, _ = ordered(
        around.where(residue != 1).select("pos", "rank", "name", "name1", "rank2"), ["name", "name1", "rank2", "pos"], ["name"], scratch, parts, rest
    )
    sampled = F.col("flagged") + F.col("rank") - more
    placed = first.select("pos", F.when(rest, F.col("place")).otherwise(sampled).alias("rank")).unionAll(
        second.select("pos", F.when(rest, F.col("place") - 1 - F.col("flagged")).otherwise(sampled).alias("rank"))
    )
    return scratch.write(placed.groupBy("pos").agg(F.sum("rank").alias("rank")))


def _bytes(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        starts = np.asarray(batch.column(0))
        pos = np.arange(len(data)) + np.repeat(starts - offsets[:-1], np.diff(offsets))
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(data.astype(np.int64) + 1)], names=["pos", "name"])


def _prefixes(length: int):
    """Where a string of ``length`` bytes starts, the hash of it."""

    def run(batches):
        for batch in batches:
            for start, row, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                at = np.arange(max(len(data) - length + 1, 0))
                found = byte_rolling(data).span(at, at + length).view(np.int64)
                arrays = [start + at, np.full(len(at), row), at, found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["pos", "row", "at", "hash"])

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                begin = np.array(starts or [], np.int64)
                begin, end = runs(begin, begin + length)
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()))
            found = list(zip(*out)) or [()] * 4
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in found[:3]], pa.array(found[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_bytes_by_order(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", alone: int = ALONE) -> DataFrame:
    """The rows of ``byte_repeats.remove_repeated_bytes`` (id, n_bytes, n_removed, n_spans, kept_sha256), read off the order of all suffixes."""
    scratch, parts = Scratch(docs.sparkSession), partitions_for(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.write(docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.monotonically_increasing_id().alias("row")))
    # A row's number has its partition in the upper bits.
    sizes = rows.select("row", F.octet_length("_text").cast("long").alias("size"), F.shiftright("row", 33).alias("part"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    ahead = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    starts = sizes.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(ahead), "part")
    placed = scratch.write(rows.join(starts.select("row", (F.col("local") + F.col("ahead")).alias("start")), "row"))
    n = totals.agg(F.sum("total")).first()[0] or 0
    string = scratch.write(placed.select("start", "_text").mapInArrow(_bytes, "pos long, name long"))
    ranks = suffix_ranks(string, n, scratch, parts, alone)
    prefixes = placed.select("start", "row", "_text").mapInArrow(_prefixes(length), "pos long, row long, at long, hash long")
    sorted_, _ = ordered(prefixes.join(ranks, "pos"), ["rank"], ["hash"], scratch, parts)
    again = sorted_.groupBy("dense").count().where("count > 1").select("dense")
    found = sorted_.join(again, "dense", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    cut = rows.join(found, "row", "left").select("_id", "_text", "starts")
    return cut.mapInArrow(_cut(length), "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_id", id_col)
