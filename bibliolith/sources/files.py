"""Corpora from files: Parquet, delimited text, JSON lines and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.normalize import normalize
from .nested_works import NESTED_WORK, flatten_works


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The commonest of comma, semicolon, tab and bar in the heading line."""
    line = spark.read.text(path).first()
    heading = line[0] if line else ""
    return max(",;\t|", key=heading.count)


def read_csv(spark: SparkSession, path: str, separator: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read by splits; with ``multi_line`` cells may hold line ends, and a file is one split."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("sep", separator or sniff_separator(spark, path)).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document that is a list of nested works, an object with ``results``, or one work."""
    wrapped = spark.read.option("multiLine", True).schema(f"{NESTED_WORK}, results array<struct<{NESTED_WORK}>>").json(path)
    listed = wrapped.where("results is not null").selectExpr("inline(results)")
    single = wrapped.where("results is null and id is not null").drop("results")
    return flatten_works(listed.unionByName(single))


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; all but nested JSON are normalised from whatever headings they have."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return read_json(spark, path)
    readers = {
        "parquet": lambda: spark.read.parquet(path),
        "jsonl": lambda: spark.read.json(path),
        "ndjson": lambda: spark.read.json(path),
        "csv": lambda: read_csv(spark, path),
        "tsv": lambda: read_csv(spark, path, "\t"),
        "txt": lambda: read_csv(spark, path),
    }
    if suffix not in readers:
        raise ValueError(f"no reader for files of type {suffix!r}")
    return normalize(readers[suffix]())
