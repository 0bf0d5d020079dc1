"""The citation graph as stored neighbour lists, so that a small corpus reads the lists of its works and not all edges.

Two tables hold each edge once a direction: ``cited`` has the citing works (with their years) of each cited one, ``citing`` the
references of each citing one.  Rows lie in order of the work, lists are sorted, and the file format codes both by what they
share with the entry before.  A work with many neighbours is cut into parts of about ``part_size`` (by a hash of the
neighbour), which are rows of their own and lie in any number of files: no list is gathered in one task.

A corpus of up to ``literal_ids`` works is looked up by equality, which the statistics of row groups answer; a larger one is
joined.  Null ids are no works; an edge that comes twice is one, and a work without edges has no row.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENDS = {"cited": ("cited_work_id", "citing_work_id"), "citing": ("citing_work_id", "cited_work_id")}
_SCHEMA = "work string, part int, neighbours array<struct<id:string,year:int>>"


def write_adjacency(edges: DataFrame, path: str, part_size: int = 4096, row_group_bytes: int = 8 << 20) -> None:
    """Store ``edges`` (cited_work_id, citing_work_id, citing_publication_year) in both directions.

    The edges are made once and kept beside the lists while these are written.  A direction moves each edge once, to the range
    of its work, where edges that come twice meet and lists are made; who is a hub is told by counts of 64-bit hashes.
    """
    spark, made = edges.sparkSession, f"{path}/edges"
    named = edges.where("cited_work_id is not null and citing_work_id is not null")
    named.withColumn("citing_publication_year", F.col("citing_publication_year").cast("int")).write.mode("overwrite").option("compression", "zstd").parquet(made)
    stored = spark.read.parquet(made)
    for table, (own, other) in _ENDS.items():
        each = stored.select(F.col(own).alias("work"), F.col(other).alias("id"), F.col("citing_publication_year").alias("year"))
        hubs = each.groupBy(F.xxhash64("work").alias("hub")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_size)
        parts = F.broadcast(hubs.select("hub", F.ceil(F.col("n") / part_size).alias("parts")))  # one in part_size edges at most
        part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = each.join(parts, F.xxhash64("work") == F.col("hub"), "left").select("work", part.alias("part"), "id", "year")
        whole = dealt.repartitionByRange("work", "part").groupBy("work", "part", "id").agg(F.max("year").alias("year"))
        lists = whole.groupBy("work", "part").agg(F.array_sort(F.collect_list(F.struct("id", "year"))).alias("neighbours"))
        writer = lists.sortWithinPartitions("work", "part").write.mode("overwrite")
        for key, value in (("compression", "zstd"), ("parquet.writer.version", "v2"), ("parquet.enable.dictionary", "false"), ("parquet.block.size", row_group_bytes)):
            writer = writer.option(key, value)
        writer.parquet(f"{path}/{table}")
    target = spark._jvm.org.apache.hadoop.fs.Path(made)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Adjacency:
    """Lookups in the stored lists; a corpus is a table with ``id``."""

    def __init__(self, spark: SparkSession, path: str, literal_ids: int = 64):
        self.literal_ids = literal_ids
        self.lists = {t: spark.read.schema(_SCHEMA).parquet(f"{path}/{t}") for t in _ENDS}

    def neighbours(self, corpus: DataFrame, table: str) -> DataFrame:
        """``work, id, year``: the edges of the corpus' works in one direction."""
        ids = corpus.select(F.col("id").alias("work")).where("work is not null").distinct()
        few = [r["work"] for r in ids.limit(self.literal_ids + 1).collect()]
        rows = self.lists[table]
        if len(few) > self.literal_ids:
            rows = rows.join(ids, "work", "left_semi")
        else:  # equalities, of which each is held against the statistics
            rows = rows.where(functools.reduce(lambda a, b: a | b, [F.col("work") == w for w in few], F.lit(False)))
        return rows.select("work", F.inline("neighbours"))

    def citing_ids(self, corpus: DataFrame) -> DataFrame:
        return self.neighbours(corpus, "cited").select("id").distinct()

    def referenced_ids(self, corpus: DataFrame) -> DataFrame:
        return self.neighbours(corpus, "citing").select("id").distinct()

    def yearly_citations(self, corpus: DataFrame) -> DataFrame:
        return self.neighbours(corpus, "cited").groupBy(F.col("year").alias("citing_publication_year")).agg(F.count(F.lit(1)).alias("citations"))
