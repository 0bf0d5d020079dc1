"""The citation graph: who cites a corpus, and what it cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_id


def edges_of(works: DataFrame) -> DataFrame:
    """Edges from the works' lists of references."""
    return works.select(
        canonical_id(F.explode("referenced_works")).alias("cited_work_id"),
        F.col("id").alias("citing_work_id"),
        F.col("publication_year").alias("citing_publication_year"),
    ).distinct()


def citing_ids(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    hit = edges.join(corpus.select(F.col("id").alias("cited_work_id")).distinct(), "cited_work_id", "left_semi")
    return hit.select(F.col("citing_work_id").alias("id")).distinct()


def referenced_ids(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    hit = edges.join(corpus.select(F.col("id").alias("citing_work_id")).distinct(), "citing_work_id", "left_semi")
    return hit.select(F.col("cited_work_id").alias("id")).distinct()


def citing_works(corpus: DataFrame, edges: DataFrame, works: DataFrame) -> DataFrame:
    return works.join(citing_ids(corpus, edges), "id", "left_semi")


def referenced_works(corpus: DataFrame, edges: DataFrame, works: DataFrame) -> DataFrame:
    return works.join(referenced_ids(corpus, edges), "id", "left_semi")


def citation_counts(corpus: DataFrame, edges: DataFrame, works: DataFrame) -> DataFrame:
    """Edges into the corpus, distinct citing works, distinct references, and the share of those among known works."""
    ids = corpus.select("id").distinct()
    into = edges.join(ids.withColumnRenamed("id", "cited_work_id"), "cited_work_id", "left_semi")
    refs = referenced_ids(corpus, edges)
    known = works.select("id", F.lit(1).alias("_known"))
    a = into.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("citing_work_id").alias("citing_works"))
    b = refs.join(known, "id", "left").agg(
        F.count(F.lit(1)).alias("references"), F.round(F.count("_known") * 100.0 / F.count(F.lit(1)), 4).alias("coverage_pct")
    )
    return a.join(b)  # two rows of one aggregate each


def yearly_citations(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    into = edges.join(corpus.select(F.col("id").alias("cited_work_id")).distinct(), "cited_work_id", "left_semi")
    return into.groupBy("citing_publication_year").agg(F.count(F.lit(1)).alias("citations"))


def matching(works: DataFrame, text: str) -> DataFrame:
    """Works whose title, authors, institutions, field or DOI contain a text."""
    needle = F.lit(text.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    lists = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), needle))
    return works.where(has("title") | has("doi") | has("field_name") | lists("author_names") | lists("institution_names"))


ENTITY_COLUMNS = {
    "locations": ("country_codes", True),
    "organizations": ("institution_names", True),
    "researchers": ("author_names", True),
    "funding_agencies": ("funder_names", True),
    "concepts": ("concepts", True),
    "keywords": ("keywords", True),
    "sector_types": ("institution_types", True),
    "publication_sources": ("source_name", False),
    "research_areas_domain": ("domain_name", False),
    "research_areas_field": ("field_name", False),
    "research_areas_subfield": ("subfield_name", False),
    "research_areas_topic": ("topic", False),
    "economic_apc": ("oa_status", False),
}


def of_entity(works: DataFrame, slug: str, name: str) -> DataFrame:
    """Works whose attribute contains a name; an unknown kind of entity searches the whole record."""
    needle = F.lit(name.lower())
    if slug not in ENTITY_COLUMNS:
        return works.where(F.contains(F.lower(F.to_json(F.struct("*"))), needle))
    column, many = ENTITY_COLUMNS[slug]
    if many:
        return works.where(F.exists(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), needle)))
    return works.where(F.contains(F.lower(column), needle))
