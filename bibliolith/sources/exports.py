"""Sinks: tables as CSV, Parquet and works dumps; packages with manifest and archive."""

from __future__ import annotations

import json
import re
import zipfile
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.documents import document_table


def write_csv(report: DataFrame, path: str) -> None:
    """One file with a heading; reports are limited to a few thousand rows."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(report: DataFrame, path: str) -> bool:
    """Written only if there is a row."""
    if report.isEmpty():
        return False
    report.write.mode("overwrite").parquet(path)
    return True


def write_works(works: DataFrame, path: str) -> None:
    """The works without their raw records and the document table, each in parallel, zstd compressed."""
    works.drop("raw_data").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/works")
    document_table(works).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents")


def write_text(lines: DataFrame, path: str) -> None:
    """A column of tagged text records as they are."""
    lines.select(lines.columns[0]).write.mode("overwrite").text(path)


def sheet_name(title: str) -> str:
    return re.sub(r"[:/\\]", "-", title)[:31]


# The folders of a package, by the kind of table they hold.
FOLDERS = {
    "matrix": "01_Matrices_Desempeño_Longitudinal",
    "periods": "02_Periodos_Consecutivos",
    "full": "03_Historico_Completo",
    "trend": "04_Tendencias_Anuales",
    "data": "05_Tablas_Parquet_y_Datos",
}


class PackageFile(NamedTuple):
    """A file and what it is: a kind of table, or nothing for what lies beside the folders (manifest, notes)."""

    path: str
    kind: str | None = None

    @property
    def place(self) -> str:
        name = Path(self.path).name
        return f"{FOLDERS[self.kind]}/{name}" if self.kind else name


def _contents(file: PackageFile) -> dict[str, Path]:
    """Places in the archive: of a file its own, of a table's folder that of its part, or of its parts in a folder."""
    path = Path(file.path)
    if path.is_file():
        return {file.place: path}
    parts = sorted(p for p in path.glob("*") if p.is_file() and p.name[0] not in "._")
    if len(parts) == 1:
        return {file.place + "".join(parts[0].suffixes[-1:]): parts[0]}
    return {f"{file.place}/{k:05}{''.join(p.suffixes[-1:])}": p for k, p in enumerate(parts)}


def write_archive(files: list[PackageFile], target: str) -> list[str]:
    """A ZIP of reports, files or the folders that Spark writes; what is missing is left out, and of those that would share a
    place the first stays."""
    chosen: dict[str, Path] = {}
    for file in files:
        for place, path in _contents(file).items():
            chosen.setdefault(place, path)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for place, path in chosen.items():
            out.write(path, place)
    return list(chosen)


def write_manifest(path: str, **facts) -> None:
    Path(path).write_text(json.dumps(facts, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
