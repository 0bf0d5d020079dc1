"""Entities by a part of their name, without scanning the names.

``entries_of`` gathers what works speak of (domains, fields, subfields, topics, types, countries, sources, institutions,
authors) with its number of works.  The index holds, for each kind, the runs of one, two and three characters of the lowered
names in order of the run: of a run of three every entry, of shorter ones the ``top`` largest.  A text of up to three characters
is a run and is read off; a longer one reads the entries of its rarest run and is looked for in their names.

Names are compared lowered; ties go by name and id.  A null or empty name is no entry; blanks around the text don't count; an
empty text finds nothing.  Short texts with a limit over ``top`` are looked for in all entries of the kind.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import COUNTRY_CODES

_SINGLE = {"domains": ("domain_name", "domain_name"), "fields": ("field_name", "field_name"), "subfields": ("subfield_name", "subfield_name"), "topics": ("topic_id", "topic"), "types": ("type", "type"), "sources": ("source_id", "source_name")}
_LISTS = {"institutions": ("institution_ids", "institution_names"), "authors": ("author_ids", "author_names")}
_TABLES = {"entries": "id string, display_name string, works long", "grams": "gram string, id string, display_name string, works long", "sizes": "gram string, n long"}


def entries_of(works: DataFrame) -> DataFrame:
    """``kind, id, display_name, works``."""
    parts = []
    for kind, (key, name) in _SINGLE.items():
        if {key, name} <= set(works.columns):
            parts.append(works.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("display_name")))
    for kind, (keys, names) in _LISTS.items():
        if {keys, names} <= set(works.columns):
            each = works.select(F.explode(F.array_distinct(F.arrays_zip(F.col(keys).alias("i"), F.col(names).alias("n")))).alias("p"))
            parts.append(each.select(F.lit(kind).alias("kind"), F.col("p.i").alias("id"), F.col("p.n").alias("display_name")))
    if "country_codes" in works.columns:
        named: dict[str, str] = {}
        for name, code in COUNTRY_CODES.items():
            named.setdefault(code, name.title())
        names = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
        code = works.select(F.explode(F.array_distinct("country_codes")).alias("id"))
        parts.append(code.select(F.lit("countries").alias("kind"), "id", F.coalesce(F.get(F.transform(F.array("id"), lambda c: names[c]), 0), "id").alias("display_name")))
    every = functools.reduce(DataFrame.unionByName, parts).where("display_name <> ''")
    return every.groupBy("kind", "id", "display_name").agg(F.count(F.lit(1)).alias("works"))


def write_entity_index(entries: DataFrame, path: str, top: int = 100, row_group_bytes: int = 8 << 20) -> None:
    def write(table: DataFrame, name: str, *order) -> None:
        dealt = table.repartitionByRange("kind", *order).sortWithinPartitions("kind", *order)
        dealt.write.mode("overwrite").option("parquet.block.size", row_group_bytes).partitionBy("kind").parquet(f"{path}/{name}")

    entries = entries.where("display_name <> ''")
    low = F.lower("display_name")
    write(entries, "entries", "id")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda k: F.substring(low, k, F.lit(n)))
    of = lambda n: entries.where(F.length(low) >= n).select("kind", F.explode(F.array_distinct(runs(n))).alias("gram"), "id", "display_name", "works")
    largest = Window.partitionBy("kind", "gram").orderBy(F.desc("works"), "display_name", "id")
    short = of(1).unionByName(of(2)).withColumn("_n", F.row_number().over(largest)).where(F.col("_n") <= top).drop("_n")  # pruned before it moves
    write(short.unionByName(of(3)), "grams", "gram", "works", "id")
    write(of(3).groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n")), "sizes", "gram")


class EntityIndex:
    def __init__(self, spark: SparkSession, path: str, top: int = 100):
        self.top = top
        self.entries, self.grams, self.sizes = (spark.read.schema(f"{s}, kind string").parquet(f"{path}/{t}") for t, s in _TABLES.items())

    def search(self, kind: str, text: str, limit: int = 20) -> DataFrame:
        """``kind, id, display_name, works`` of the largest entries whose name contains ``text``."""
        low = text.strip().lower()
        held = F.contains(F.lower("display_name"), F.lit(low))
        if len(low) < 3 and limit > self.top:
            found = self.entries.where((F.col("kind") == kind) & held)
        elif len(low) <= 3:
            found = self.grams.where((F.col("kind") == kind) & (F.col("gram") == low))
        else:
            runs = sorted({low[k : k + 3] for k in range(len(low) - 2)})
            sizes = {r["gram"]: r["n"] for r in self.sizes.where((F.col("kind") == kind) & F.col("gram").isin(runs)).collect()}
            rarest = min(runs, key=lambda g: (sizes.get(g, 0), g))  # one that no name has finds nothing
            found = self.grams.where((F.col("kind") == kind) & (F.col("gram") == rarest) & held)
        if not low:
            found = found.where(F.lit(False))
        return found.select("kind", "id", "display_name", "works").orderBy(F.desc("works"), "display_name", "id").limit(limit)
