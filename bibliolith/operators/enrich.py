"""Joins to dimensions: names and countries of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_per_key(dimension: DataFrame, key: Column, *values: Column) -> DataFrame:
    """A dimension may name a thing twice: the least value decides, so reruns agree."""
    return dimension.groupBy(key.alias("_key")).agg(*[F.min(v).alias(f"_v{i}") for i, v in enumerate(values)])


def with_source_names(table: DataFrame, sources: DataFrame, key: str = "name") -> DataFrame:
    """``display_name`` and ``country`` of a source by id; a key that is no id keeps its name, and has the country of
    the source of that name, or of that name in lower case; those unknown have none."""
    by_id = _one_per_key(sources, F.col("id"), F.col("display_name"), F.col("country_code"))
    by_name = _one_per_key(sources, F.col("display_name"), F.col("country_code")).withColumnsRenamed({"_key": "_name", "_v0": "_v2"})
    folded = _one_per_key(sources, F.lower("display_name"), F.col("country_code")).withColumnsRenamed({"_key": "_low", "_v0": "_v3"})
    out = table.join(by_id, table[key] == by_id["_key"], "left")
    out = out.join(by_name, table[key] == by_name["_name"], "left").join(folded, F.lower(table[key]) == folded["_low"], "left")
    return out.select(
        table["*"], F.coalesce(by_id["_v0"], table[key]).alias("display_name"), F.coalesce(by_id["_v1"], "_v2", "_v3", F.lit("")).alias("country")
    )


def with_country(table: DataFrame, dimension: DataFrame, name: str, country: Column, key: str = "name") -> DataFrame:
    """A country by exact name, else by the name in lower case, else the key if it is a country code itself."""
    exact = _one_per_key(dimension, F.col(name), country)
    folded = _one_per_key(dimension, F.lower(name), country).withColumnsRenamed({"_key": "_low", "_v0": "_v1"})
    out = table.join(exact, table[key] == exact["_key"], "left").join(folded, F.lower(table[key]) == folded["_low"], "left")
    own = F.when(F.rlike(table[key], F.lit("^[A-Z]{2}$")), table[key])
    return out.select(table["*"], F.coalesce("_v0", "_v1", own, F.lit("")).alias("country"))


def raw_country(column: str = "raw_data") -> Column:
    return F.get_json_object(column, "$.country_code")


def raw_region(column: str = "raw_data") -> Column:
    return F.get_json_object(column, "$.geo.region")


def author_country(authors: DataFrame, institutions: DataFrame) -> DataFrame:
    """``name, country`` of authors: the last known institution's own code, or the code of the one so named."""
    own = F.get_json_object("raw_data", "$.last_known_institutions[0].country_code")
    named = _one_per_key(institutions, F.col("display_name"), F.col("country_code"))
    held = authors.join(named, authors["last_known_institution_name"] == named["_key"], "left")
    return held.groupBy(F.col("display_name").alias("name")).agg(F.min(F.coalesce(own, "_v0")).alias("country"))


def first_last(name: Column) -> Column:
    """``Last, First`` as ``First Last``."""
    parts = F.split(name, r",\s*", 2)
    return F.when(F.contains(name, F.lit(",")), F.concat_ws(" ", F.element_at(parts, 2), F.element_at(parts, 1))).otherwise(name)


def backfill_source_names(works: DataFrame, sources: DataFrame) -> DataFrame:
    """Names from the dimension, only if no work has one."""
    if not works.where("coalesce(source_name, '') <> ''").isEmpty():
        return works
    known = _one_per_key(sources, F.col("id"), F.col("display_name"))
    filled = works.drop("source_name").join(known, works["source_id"] == known["_key"], "left")
    return filled.withColumn("source_name", F.coalesce("_v0", F.lit(""))).drop("_key", "_v0")
