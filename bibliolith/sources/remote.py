"""Paged remote sources: how a query is split into requests, and how answers are merged.

The transport is a parameter, a function from (query, first year, last year, start, count) to
(entries, total); the network is its business.  One Spark partition reads one bracket of years.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import dedup_by_first_key

Transport = Callable[[str, int, int, int, int], tuple[list[dict], int]]
KEYS = ["eid", "doi", "identifier", "title"]


def year_brackets(count: Callable[[int, int], int], start: int, end: int, most: int = 5000) -> list[tuple[int, int]]:
    """Year ranges of at most ``most`` hits each, halved as needed; single years stay whole."""
    if start >= end or count(start, end) <= most:
        return [(start, end)]
    middle = (start + end) // 2
    return year_brackets(count, start, middle, most) + year_brackets(count, middle + 1, end, most)


def harvest(spark: SparkSession, fetch: Transport, query: str, start: int, end: int, page: int = 200, most: int = 5000) -> DataFrame:
    """All entries of a query, once each by their first identifier."""
    brackets = year_brackets(lambda a, b: fetch(query, a, b, 0, 0)[1], start, end, most)
    jobs = spark.createDataFrame(brackets, "a int, b int").repartition(len(brackets))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, total = 0, 1
                while at < total:
                    entries, total = fetch(query, a, b, at, page)
                    at += page
                    yield pa.RecordBatch.from_pydict({"entry": [json.dumps(e) for e in entries]}, pa.schema([("entry", pa.string())]))

    rows = jobs.mapInArrow(read, "entry string")
    fields = rows.select(*[F.get_json_object("entry", f"$.{k}").alias(k) for k in KEYS], "entry")
    return dedup_by_first_key(fields, KEYS)
