"""Nested work records (authorships, topics, locations) to flat rows, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_id

_NAMED = "struct<id:string,display_name:string>"
NESTED_WORK = (
    "id string, doi string, title string, display_name string, type string, publication_year int, publication_date string, "
    "cited_by_count bigint, fwci double, "
    "citation_normalized_percentile struct<value:double,is_in_top_10_percent:boolean,is_in_top_1_percent:boolean>, "
    f"authorships array<struct<author:{_NAMED},institutions:array<struct<id:string,display_name:string,ror:string,type:string,"
    "country_code:string>>,countries:array<string>>>, "
    f"primary_topic struct<id:string,display_name:string,subfield:{_NAMED},field:{_NAMED},domain:{_NAMED}>, "
    f"concepts array<{_NAMED}>, keywords array<{_NAMED}>, sustainable_development_goals array<{_NAMED}>, "
    "primary_location struct<source:struct<id:string,display_name:string,type:string,is_in_doaj:boolean,is_core:boolean>,license:string>, "
    "open_access struct<is_oa:boolean,oa_status:string>, indexed_in array<string>, "
    "apc_paid struct<value_usd:double>, apc_list struct<value_usd:double>, "
    "funders array<struct<id:string,display_name:string>>, grants array<struct<funder:string,funder_display_name:string>>, "
    "referenced_works array<string>, referenced_works_count int, is_retracted boolean, is_paratext boolean, has_repository_fulltext boolean"
)
_EMPTY = "array<string>"


def _names(column: Column) -> Column:
    """Distinct trimmed texts without empty ones; nothing if the list is missing."""
    kept = F.filter(F.transform(column, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.coalesce(kept, F.array().cast(_EMPTY)))


def _short(column: Column) -> Column:
    return _names(F.transform(column, lambda x: F.element_at(F.split(x, "/"), -1)))


def _flag(column: Column) -> Column:
    return F.coalesce(column, F.lit(False)).cast("int")


def flatten_works(nested: DataFrame) -> DataFrame:
    """Flat works from columns of NESTED_WORK."""
    institutions = F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"], F.array().cast(_INSTITUTIONS))))
    work = nested.withColumn("_institutions", institutions)
    countries = F.concat(
        F.coalesce(F.col("_institutions.country_code"), F.array().cast(_EMPTY)),
        F.coalesce(F.flatten(F.transform("authorships", lambda a: F.coalesce(a["countries"], F.array().cast(_EMPTY)))), F.array().cast(_EMPTY)),
    )
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    tail = lambda name: F.coalesce(canonical_id(F.col(name)), F.lit(""))
    codes = _names(countries)
    funders = F.concat(_names(F.col("funders.display_name")), _names(F.col("grants.funder_display_name")))
    return work.select(
        tail("id").alias("id"),
        text("doi").alias("doi"),
        F.coalesce("title", "display_name", F.lit("Sin título")).alias("title"),
        text("type").alias("type"),
        F.coalesce("publication_year", F.lit(0)).alias("publication_year"),
        text("publication_date").alias("publication_date"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.coalesce("fwci", F.lit(0.0)).alias("fwci"),
        F.coalesce(F.col("citation_normalized_percentile.value"), F.lit(0.0)).alias("percentile"),
        _flag(F.col("citation_normalized_percentile.is_in_top_10_percent")).alias("is_top_10"),
        _flag(F.col("citation_normalized_percentile.is_in_top_1_percent")).alias("is_top_1"),
        _flag(F.col("open_access.is_oa")).alias("is_oa"),
        F.coalesce(F.col("open_access.oa_status"), F.lit("closed")).alias("oa_status"),
        tail("primary_location.source.id").alias("source_id"),
        text("primary_location.source.display_name").alias("source_name"),
        text("primary_location.source.type").alias("source_type"),
        text("primary_location.license").alias("license"),
        _names(F.col("authorships.author.display_name")).alias("author_names"),
        _short(F.col("authorships.author.id")).alias("author_ids"),
        _names(F.col("_institutions.display_name")).alias("institution_names"),
        _short(F.col("_institutions.id")).alias("institution_ids"),
        _names(F.col("_institutions.ror")).alias("institution_rors"),
        _names(F.col("_institutions.type")).alias("institution_types"),
        codes.alias("country_codes"),
        codes.alias("all_country_codes"),
        F.coalesce(F.get(codes, 0), F.lit("")).alias("country_code"),
        *[text(f"primary_topic.{n}.display_name").alias(f"{n}_name") for n in ("domain", "field", "subfield")],
        *[tail(f"primary_topic.{n}.id").alias(f"{n}_id") for n in ("domain", "field", "subfield")],
        text("primary_topic.display_name").alias("topic"),
        tail("primary_topic.id").alias("topic_id"),
        _names(F.col("sustainable_development_goals.id")).alias("sdgs"),
        _short(F.col("sustainable_development_goals.id")).alias("sdg_ids"),
        _names(F.col("concepts.display_name")).alias("concepts"),
        _short(F.col("concepts.id")).alias("concept_ids"),
        _names(F.col("keywords.display_name")).alias("keywords"),
        F.array_distinct(funders).alias("funder_names"),
        F.coalesce(F.col("apc_paid.value_usd"), F.lit(0.0)).alias("apc_paid_usd"),
        F.coalesce(F.col("apc_list.value_usd"), F.lit(0.0)).alias("apc_list_usd"),
        _short(F.col("referenced_works")).alias("referenced_works"),
        F.coalesce("referenced_works_count", F.lit(0)).alias("referenced_works_count"),
        _flag(F.col("is_retracted")).alias("is_retracted"),
        _flag(F.col("is_paratext")).alias("is_paratext"),
        _flag(F.coalesce(F.col("primary_location.source.is_in_doaj"), F.lit(False)) | F.coalesce(F.array_contains("indexed_in", "doaj"), F.lit(False))).alias(
            "is_doaj_indexed"
        ),
        _flag(F.col("primary_location.source.is_core")).alias("is_core_journal"),
        _flag(F.col("has_repository_fulltext")).alias("has_repository_fulltext"),
    )


_INSTITUTIONS = "array<struct<id:string,display_name:string,ror:string,type:string,country_code:string>>"
