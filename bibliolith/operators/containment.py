"""Whether one corpus lies inside another by their filters alone, and answers from what is stored of the larger one.

A filter is a conjunction over dimensions, so it lies inside another one if in each dimension that the other restricts its own
restriction is at least as strong: a range of years inside a range, a set of values inside a set.  Where works carry
several values, a set asks for any of them (OR) or for all (AND), which gives four cases.  The proof never says yes wrongly;
it may say no to what holds only by the data (a field's works are all of its domain).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cubes
from .filters import ANY, FIRST_YEAR, LAST_YEAR, TRUTHY, filter_works, short_values, values_of

# Dimensions of works with several values: their keys in a filter, and the key of the logic.
GROUPED = {
    "topic": (("topic_ids", "topics"), ("topic_id", "topic"), "topic_logic"),
    "institution": (("institution_ids",), ("institution_id",), "institution_logic"),
    "author": (("author_ids",), ("author_id",), "author_logic"),
    "country": (("country_codes",), ("country_code",), "country_logic"),
}
LEVELS = ("domain", "field", "subfield")


def _years(f: dict) -> tuple[int, int]:
    return int(f.get("start_year") or FIRST_YEAR), int(f.get("end_year") or LAST_YEAR)


def _types(f: dict) -> set[str]:
    return {v.lower() for v in values_of(f, ("work_types", "types"), ("type", "work_type")) if v.lower() not in ANY}


def _status(f: dict) -> str:
    value = str(f.get("oa_status") or "").strip().lower()
    return "" if value in ANY else value


def _title(f: dict) -> str:
    return next((str(f[k]).strip() for k in ("query", "search_query", "q") if f.get(k)), "")


def _group(f: dict, name: str) -> tuple[set[str], bool]:
    plural, single, logic = GROUPED[name]
    values = values_of(f, plural, single)
    found = {v.upper() for v in values} if name == "country" else set(short_values(values))
    return found, str(f.get(logic) or "OR").strip().upper() == "AND"


def _implied(inner: tuple[set[str], bool], outer: tuple[set[str], bool]) -> bool:
    """Whether works with any (all) of one set surely have any (all) of the other."""
    (own, own_all), (other, other_all) = inner, outer
    if not other:
        return True
    if not own:
        return False
    if other_all:
        return other <= own if own_all or len(own) == 1 else False
    return bool(own & other) if own_all else own <= other


def contains(outer: dict, inner: dict) -> bool:
    """Whether every work that ``inner`` selects, from whatever table, ``outer`` selects too."""
    (a, b), (c, d) = _years(outer), _years(inner)
    if c > d:
        return True  # no work
    if not (a <= c and d <= b):
        return False
    if outer.get("is_oa") is not None and (inner.get("is_oa") is None or (outer["is_oa"] in TRUTHY) != (inner["is_oa"] in TRUTHY)):
        return False
    if _status(outer) and _status(outer) != _status(inner):
        return False
    if any(outer.get(flag) and not inner.get(flag) for flag in ("is_doaj", "is_core")):
        return False
    sets = [(_types(outer), _types(inner))]
    sets.append(tuple(set(short_values(values_of(f, ("source_ids",), ("source_id",)))) for f in (outer, inner)))
    sets += [tuple(set(values_of(f, (f"{n}_ids", f"{n}s"), (n, f"{n}_id"))) for f in (outer, inner)) for n in LEVELS]
    if any(wide and not (narrow and narrow <= wide) for wide, narrow in sets):
        return False
    if not all(_implied(_group(inner, n), _group(outer, n)) for n in GROUPED):
        return False
    wide, narrow = _title(outer), _title(inner)
    return not wide or wide == narrow or (wide.isascii() and narrow.isascii() and wide.lower() in narrow.lower())


def answer(stored: Mapping[str, tuple[dict, int]], wanted: dict) -> str | None:
    """The name of the smallest stored corpus (filters and number of works) that surely holds ``wanted``; None if there is none."""
    held = [(size, name) for name, (filters, size) in stored.items() if contains(filters, wanted)]
    return min(held)[1] if held else None


def from_stored(table: DataFrame, wanted: dict) -> DataFrame:
    """``wanted`` from the stored works of a corpus that contains it."""
    return filter_works(table, wanted)


_CUBE_KEYS = {"start_year", "end_year", "source_ids", "source_id"}


def from_sources_cube(cube: DataFrame, wanted: dict) -> DataFrame | None:
    """All indicators of ``wanted`` from the cube of sources, if it restricts nothing but sources and years.

    A work has one source, so cells of some sources add up to their works; other cubes count a work for each of its keys.
    """
    sources = short_values(values_of(wanted, ("source_ids",), ("source_id",)))
    if not sources or any(v for k, v in wanted.items() if k not in _CUBE_KEYS):
        return None
    own = cube.where(F.col("source").isin(sources)).withColumn("corpus", F.lit("corpus"))
    return cubes.report(own, ["corpus"], _years(wanted)).drop("corpus")

