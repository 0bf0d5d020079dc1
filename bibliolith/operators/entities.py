"""The seventeen kinds of entity that works are grouped by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the Sustainable Development Goals.
SDG_NAMES = (
    "SDG 01: No Poverty",
    "SDG 02: Zero Hunger",
    "SDG 03: Good Health and Well-being",
    "SDG 04: Quality Education",
    "SDG 05: Gender Equality",
    "SDG 06: Clean Water and Sanitation",
    "SDG 07: Affordable and Clean Energy",
    "SDG 08: Decent Work and Economic Growth",
    "SDG 09: Industry, Innovation and Infrastructure",
    "SDG 10: Reduced Inequalities",
    "SDG 11: Sustainable Cities and Communities",
    "SDG 12: Responsible Consumption and Production",
    "SDG 13: Climate Action",
    "SDG 14: Life Below Water",
    "SDG 15: Life on Land",
    "SDG 16: Peace, Justice and Strong Institutions",
    "SDG 17: Partnerships for the Goals",
)
WHOLE_CORPUS = "Corpus Completo"


def sdg_name(column: Column) -> Column:
    last = F.element_at(F.split(column, "/"), -1)
    names = F.create_map(*[x for i, n in enumerate(SDG_NAMES, 1) for x in (F.lit(str(i)), F.lit(n))])
    return F.coalesce(F.try_element_at(names, last), column)


@dataclass(frozen=True)
class Entity:
    slug: str
    label: str
    key: Callable[[], Column]
    many: bool = True
    spread: bool = False  # nearly each row has a name of its own


def _array(name: str) -> Callable[[], Column]:
    return lambda: F.array_distinct(F.coalesce(F.col(name), F.array().cast("array<string>")))


def _pairs() -> Column:
    """Unordered pairs of distinct institutions of a work."""
    names = F.array_sort(F.array_distinct(F.filter("institution_names", lambda x: x != "")))
    later = lambda i: F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1)))
    return F.flatten(F.transform(names, lambda a, i: F.transform(later(i), lambda b: F.concat(a, F.lit(" --- "), b))))


ENTITIES = {
    e.slug: e
    for e in (
        Entity("corpus", "Corpus", lambda: F.lit(WHOLE_CORPUS), many=False),
        Entity("locations", "Locations", _array("country_codes")),
        Entity("locations_subnational", "Locations Subnational", _array("country_codes")),
        Entity("organizations", "Organizations", _array("institution_names")),
        Entity("organizations_colab", "Organizations Colab", _pairs, spread=True),
        Entity("sector_types", "Sector Types", _array("institution_types")),
        Entity("researchers", "Researchers", _array("author_names")),
        Entity("publication_sources", "Publication Sources", lambda: F.col("source_id"), many=False),
        Entity("funding_agencies", "Funding Agencies", _array("funder_names")),
        Entity("research_areas_domain", "Research Areas Domain", lambda: F.col("domain_name"), many=False),
        Entity("research_areas_field", "Research Areas Field", lambda: F.col("field_name"), many=False),
        Entity("research_areas_subfield", "Research Areas Subfield", lambda: F.col("subfield_name"), many=False),
        Entity(
            "research_areas_topic",
            "Research Areas Topic",
            lambda: F.when(F.coalesce("topic", F.lit("")) != "", F.col("topic")).otherwise(F.col("topic_id")),
            many=False,
        ),
        Entity(
            "research_areas_sdg",
            "Research Areas SDG",
            lambda: F.array_distinct(F.transform(F.coalesce("sdgs", F.array().cast("array<string>")), sdg_name)),
        ),
        Entity("concepts", "Concepts", _array("concepts")),
        Entity("keywords", "Keywords", _array("keywords")),
        Entity("economic_apc", "Economic APC Breakdown", lambda: F.col("oa_status"), many=False),
    )
}
DEFAULT_ENTITIES = ("corpus", "locations", "organizations", "researchers", "publication_sources")

# What the indicators read: everything else is pruned before works are multiplied.
MEASURED = (
    "publication_year cited_by_count fwci percentile is_top_10 is_top_1 is_oa oa_status is_doaj_indexed is_core_journal "
    "all_country_codes institution_types apc_paid_usd is_retracted is_paratext"
).split()


def by_entity(works: DataFrame, entity: Entity) -> DataFrame:
    """A row for each work and each of its entities, named ``name``; nameless ones vanish."""
    key = F.explode(entity.key()) if entity.many else entity.key()
    return works.select(*MEASURED, key.alias("name")).where("name <> ''")
