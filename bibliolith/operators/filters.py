"""Structured filters: a dictionary becomes one condition on works."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_id

FIRST_YEAR, LAST_YEAR = 1970, 2026
ANY = {"", "all", "todos", "any"}
TRUTHY = (1, True, "true", "1", "True")


def values_of(filters: dict, plural: tuple[str, ...], single: tuple[str, ...]) -> list[str]:
    """Values given as a list, a comma string or one under a singular key; the caller's lists are left alone."""
    found = next((filters[k] for k in plural if filters.get(k)), [])
    out = found.split(",") if isinstance(found, str) else list(found)
    out += [filters[k] for k in single if filters.get(k)][:1]
    return list(dict.fromkeys(str(v).strip() for v in out if str(v).strip()))


def short_values(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v.split("/")[-1].strip() for v in values))


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions) if conditions else F.lit(False)


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions) if conditions else F.lit(True)


class WorkFilter:
    """Compiles filters against the columns a works table has; a column it lacks matches nothing."""

    def __init__(self, works: DataFrame):
        self.columns = set(works.columns)

    def _is(self, names: tuple[str, ...], values: list[str], ids: bool = False) -> list[Column]:
        held = [n for n in names if n in self.columns]
        return [F.coalesce((canonical_id(F.col(n)) if ids else F.col(n)).isin(values), F.lit(False)) for n in held]

    def _has(self, names: tuple[str, ...], values: list[str], every: bool = False) -> list[Column]:
        out = []
        for n in (n for n in names if n in self.columns):
            items = F.transform(F.coalesce(F.col(n), F.array().cast("array<string>")), lambda x: F.element_at(F.split(x, "/"), -1))
            out.append(F.arrays_overlap(items, F.array(*[F.lit(v) for v in values])))
        return out

    def _grouped(self, values: list[str], logic: str, match) -> Column:
        """All values at once for OR; a condition for each for AND."""
        if str(logic or "OR").strip().upper() == "AND":
            return _all([_any(match([v])) for v in values])
        return _any(match(values))

    def years(self, f: dict) -> Column:
        return F.col("publication_year").between(int(f.get("start_year") or FIRST_YEAR), int(f.get("end_year") or LAST_YEAR))

    def level(self, name: str, f: dict) -> Column | None:
        values = values_of(f, (f"{name}_ids", f"{name}s"), (name, f"{name}_id"))
        if not values:
            return None
        return _any(self._is((f"{name}_name", name), values) + self._is((f"{name}_id",), short_values(values), ids=True))

    def topic(self, f: dict) -> Column | None:
        values = short_values(values_of(f, ("topic_ids", "topics"), ("topic_id", "topic")))
        match = lambda v: self._is(("topic_id", "primary_topic_id"), v, ids=True) + self._has(("all_topics",), v) + self._is(("topic",), v)
        return self._grouped(values, f.get("topic_logic"), match) if values else None

    def source(self, f: dict) -> Column | None:
        values = short_values(values_of(f, ("source_ids",), ("source_id",)))
        return _any(self._is(("source_id",), values, ids=True)) if values else None

    def institution(self, f: dict) -> Column | None:
        values = short_values(values_of(f, ("institution_ids",), ("institution_id",)))
        match = lambda v: self._has(("institution_ids", "institution_rors"), v)
        return self._grouped(values, f.get("institution_logic"), match) if values else None

    def author(self, f: dict) -> Column | None:
        values = short_values(values_of(f, ("author_ids",), ("author_id",)))
        return self._grouped(values, f.get("author_logic"), lambda v: self._has(("author_ids",), v)) if values else None

    def country(self, f: dict) -> Column | None:
        values = [v.upper() for v in values_of(f, ("country_codes",), ("country_code",))]
        match = lambda v: self._is(("country_code",), v) + self._has(("country_codes", "all_country_codes"), v)
        return self._grouped(values, f.get("country_logic"), match) if values else None

    def work_type(self, f: dict) -> Column | None:
        values = [v.lower() for v in values_of(f, ("work_types", "types"), ("type", "work_type")) if v.lower() not in ANY]
        return F.lower("type").isin(values) if values else None

    def open_access(self, f: dict) -> Column | None:
        return None if f.get("is_oa") is None else F.col("is_oa") == int(f["is_oa"] in TRUTHY)

    def oa_status(self, f: dict) -> Column | None:
        value = str(f.get("oa_status") or "").strip().lower()
        return None if value in ANY else F.lower("oa_status") == value

    def title(self, f: dict) -> Column | None:
        value = next((str(f[k]).strip() for k in ("query", "search_query", "q") if f.get(k)), "")
        return F.contains(F.lower("title"), F.lower(F.lit(value))) if value else None

    def flags(self, f: dict) -> list[Column]:
        pairs = {"is_doaj": ("is_doaj_indexed", "journal_is_in_doaj"), "is_core": ("is_core_journal", "journal_is_core")}
        return [_any([F.col(c) == 1 for c in names if c in self.columns]) for key, names in pairs.items() if f.get(key)]

    def condition(self, filters: dict, search: Column | None = None, search_has_year: bool = False) -> Column:
        """Conditions joined by AND, the cheapest first.  A search without explicit years adds no year range."""
        explicit = "start_year" in filters or "end_year" in filters
        parts = [self.years(filters)] if explicit or search is None else []
        parts += [self.open_access(filters), self.oa_status(filters), *self.flags(filters), self.work_type(filters), self.source(filters)]
        parts += [self.level(n, filters) for n in ("domain", "field", "subfield")]
        parts += [self.country(filters), self.topic(filters), self.institution(filters), self.author(filters), self.title(filters), search]
        return _all([p for p in parts if p is not None])


ENTITY_KEYS = (
    "topic_ids topics source_ids institution_ids author_ids country_codes domain_ids field_ids subfield_ids work_types"
).split()


def has_other_entities(filters: dict) -> bool:
    """Whether anything but a search expression narrows the corpus to entities."""
    return any(bool(filters.get(k)) for k in ENTITY_KEYS)


def filter_works(works: DataFrame, filters: dict, search: Column | None = None) -> DataFrame:
    return works.where(WorkFilter(works).condition(filters, search))
