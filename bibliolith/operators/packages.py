"""Report packages: all tables of the chosen entities, written side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from ..sources import exports
from . import reports
from .entities import DEFAULT_ENTITIES, ENTITIES, Entity
from .indicators import display
from .periods import Period


def chosen(names: list[str] | str | None) -> list[Entity]:
    """Entities by slug or label; ``all`` is all, and unknown names alone fall back to the default."""
    if names == "all":
        return list(ENTITIES.values())
    wanted = {n.lower() for n in (names or [])}
    found = [e for e in ENTITIES.values() if e.slug in wanted or e.label.lower() in wanted]
    return found or [ENTITIES[s] for s in DEFAULT_ENTITIES]


def write_package(
    works: DataFrame, path: str, periods: list[Period], names: list[str] | str | None = None, workers: int = 4
) -> list[exports.PackageFile]:
    """Tables under ``path``, with the kind of each; of a table without rows there is none.  Entities run side by side, and
    each reads the columns that it needs."""

    def one(entity: Entity) -> list[exports.PackageFile]:
        tables = {
            ("Full", "full"): display(reports.full_table(works, entity)),
            ("Trend", "trend"): display(reports.trend_table(works, entity)),
            ("Performance Matrix", "matrix"): reports.matrix(works, entity, periods),
        }
        files = [(exports.PackageFile(f"{path}/{entity.label} {title}", kind), table) for (title, kind), table in tables.items()]
        return [file for file, table in files if exports.write_parquet(table, file.path)]

    with ThreadPoolExecutor(workers) as pool:
        return [file for files in pool.map(one, chosen(names)) for file in files]
