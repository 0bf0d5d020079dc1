"""Corpora: sets of works, lazily selected, counted, paged and derived from one another."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_id, canonical_ids, doi_key
from .filters import filter_works


def by_ids(works: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Works whose id is listed, bare or as a URL.  A list from the driver is small; a table joins as large as it is."""
    if not isinstance(ids, DataFrame):
        wanted = works.sparkSession.createDataFrame([(i,) for i in canonical_ids(ids)], "_wanted string")
    else:
        wanted = ids.select(canonical_id(F.col(ids.columns[0])).alias("_wanted")).distinct()
    return works.join(wanted, canonical_id(works["id"]) == wanted["_wanted"], "left_semi")


def by_dois(works: DataFrame, dois: list[str]) -> DataFrame:
    wanted = works.sparkSession.createDataFrame([(d,) for d in dict.fromkeys(dois)], "_doi string")
    wanted = wanted.select(doi_key(F.col("_doi")).alias("_wanted")).distinct()
    return works.join(wanted, doi_key(works["doi"]) == wanted["_wanted"], "left_semi")


def summary(works: DataFrame) -> DataFrame:
    return works.agg(
        F.count(F.lit(1)).alias("total"), F.min("publication_year").alias("min_year"), F.max("publication_year").alias("max_year")
    )


def most_cited(works: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return works.orderBy(F.col("cited_by_count").desc(), "id").offset(offset).limit(limit)


def bounded(works: DataFrame, limit: int) -> DataFrame:
    """The first works by id; counts of it are counts of what is kept."""
    return works.orderBy("id").limit(limit)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    page: int
    total: int
    total_pages: int


def page(works: DataFrame, limit: int = 25, offset: int = 0) -> Page:
    total = works.count()
    return Page(most_cited(works, limit, offset), offset // limit + 1, total, math.ceil(total / limit))


class Corpus:
    """A selection of works with where it came from."""

    def __init__(self, works: DataFrame, edges: DataFrame | None = None, lineage: tuple[str, ...] = ()):
        self.works, self.edges, self.lineage = works, edges, lineage

    @classmethod
    def load(cls, works: DataFrame, source: list[str]) -> "Corpus":
        """A list of identifiers: DOIs if the first looks like one, else ids."""
        first = source[0] if source else ""
        if first.startswith("10.") or "doi.org" in first:
            return cls(by_dois(works, source), lineage=("dois",))
        return cls(by_ids(works, source), lineage=("ids",))

    def where(self, filters: dict, search: Column | None = None) -> "Corpus":
        return Corpus(filter_works(self.works, filters, search), self.edges, (*self.lineage, "filters"))

    def citing(self, all_works: DataFrame, edges: DataFrame) -> "Corpus":
        from .citations import citing_works

        return Corpus(citing_works(self.works, edges, all_works), edges, (*self.lineage, "citing"))

    def references(self, all_works: DataFrame, edges: DataFrame) -> "Corpus":
        from .citations import referenced_works

        return Corpus(referenced_works(self.works, edges, all_works), edges, (*self.lineage, "references"))
