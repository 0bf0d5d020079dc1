"""Remote sources as Spark data sources: planned jobs, a shared rate, and harvests that go on where they stopped.

``remote_source`` makes a data source from a transport, so that ``spark.read.format(name)`` scans it.  A search is split into
brackets of years, a list of ids into batches; these are the jobs.  Jobs are dealt to ``readers`` partitions, each of which
spaces its requests by readers / rate seconds, so all together keep the rate wherever they run.  Conditions on ``year`` narrow
the years that are asked for at all.

``harvest_into`` stores a scan in waves.  The plan is stored first.  A job's entries and the mark that it is done are rows of
one write, so a job counts when its wave is committed and not before: what fails (after ``retries``) or meets a quota is asked
again by the next call, and nothing is lost or doubled.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .remote import Transport, year_brackets

SCHEMA = "job string, year int, entry string"
Records = Callable[[list[str]], list[dict]]


class QuotaExceeded(Exception):
    """Raised by a transport that may not ask any more: further attempts are of no use now."""


@dataclass
class Share(InputPartition):
    """The jobs of one reader and the seconds between its requests."""

    jobs: list[list]
    pause: float


class _Reader(DataSourceReader):
    def __init__(self, options: dict, search: Transport | None, records: Records | None, year_of: Callable[[dict], int | None]):
        self.options, self.search, self.records, self.year_of = options, search, records, year_of
        self.first, self.last = int(options.get("start", 0)), int(options.get("end", 0))

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("year",) and self.search:
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.last = min(self.last, f.value)
                if isinstance(f, GreaterThan):
                    self.first = max(self.first, f.value + 1)
                if isinstance(f, LessThan):
                    self.last = min(self.last, f.value - 1)
            yield f  # Spark asks the entries themselves once more

    def jobs(self) -> list[list]:
        if given := self.options.get("jobs"):
            return json.loads(given)
        if ids := self.options.get("ids"):
            listed, size = list(dict.fromkeys(i.strip() for i in ids.split(",") if i.strip())), int(self.options.get("batch", 500))
            return [["ids", k // size, *listed[k : k + size]] for k in range(0, len(listed), size)]
        if self.first > self.last:
            return []
        count = lambda a, b: self._ask(lambda: self.search(self.options["query"], a, b, 0, 0))[1]
        return [["years", a, b] for a, b in year_brackets(count, self.first, self.last, int(self.options.get("most", 5000)))]

    def partitions(self):
        jobs, rate = self.jobs(), float(self.options.get("rate", 0))
        readers = max(min(int(self.options.get("readers", 4)), len(jobs)), 1)
        return [Share(jobs[k::readers], readers / rate if rate else 0.0) for k in range(readers)]

    def _ask(self, request):
        for attempt in range(int(self.options.get("retries", 3)) + 1):
            try:
                return request()
            except QuotaExceeded:
                raise
            except Exception:
                if attempt == int(self.options.get("retries", 3)):
                    raise
                time.sleep(float(self.options.get("backoff", 0.5)) * 2**attempt)

    def _entries(self, job: list, spaced: Callable) -> list[dict]:
        """All entries of a job: at most a bracket's or a batch's."""
        kind, *of = job
        if kind == "ids":
            return spaced(lambda: self.records(of[1:]))
        found, total, page = [], 1, int(self.options.get("page", 200))
        at = 0
        while at < total:
            entries, total = spaced(lambda at=at: self.search(self.options["query"], *of, at, page))
            found += entries
            at += page
        return found

    def read(self, partition: Share):
        asked = None

        def spaced(request):
            def once():
                nonlocal asked
                if asked is not None:
                    time.sleep(max(0.0, partition.pause - (time.monotonic() - asked)))
                asked = time.monotonic()
                return request()

            return self._ask(once)

        for job in partition.jobs:
            name = f"{job[0]} {job[1]}" + (f" {job[2]}" if job[0] == "years" else "")
            try:
                entries = self._entries(job, spaced)
            except QuotaExceeded:
                if self.options.get("strict", "true") == "true":
                    raise
                return
            except Exception:
                if self.options.get("strict", "true") == "true":
                    raise
                continue
            for e in entries:
                yield (name, self.year_of(e), json.dumps(e, ensure_ascii=False))
            if self.options.get("marks") == "true":
                yield (name, None, None)


def remote_source(
    name: str, search: Transport | None = None, records: Records | None = None, year_of: Callable[[dict], int | None] = lambda e: e.get("year")
) -> type[DataSource]:
    """A data source to register.  Options: ``query``, ``start``, ``end`` or ``ids`` (comma separated); ``batch`` ids a request,
    ``page`` entries a request, ``most`` entries a bracket, ``readers``, ``rate`` (requests a second, all together), ``retries``."""

    class Remote(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Reader(dict(self.options), search, records, year_of)

    return Remote


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a source known to a session, with conditions pushed into it (which Python sources must be allowed to take)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def harvest_into(spark: SparkSession, source: type[DataSource], path: str, wave_jobs: int = 64, **options) -> int:
    """Store the entries of a scan under ``path``; how many jobs are left open (call again for these)."""
    register(spark, source)
    options = {k: str(v) for k, v in options.items()}
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration())
    exists = lambda p: there.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{p}"))
    if not exists("plan/_SUCCESS"):
        jobs = source(options).reader(None).jobs()
        spark.createDataFrame([(json.dumps(j),) for j in jobs], "value string").write.mode("overwrite").text(f"{path}/plan")
    plan = {f"{j[0]} {j[1]}" + (f" {j[2]}" if j[0] == "years" else ""): j for j in (json.loads(r[0]) for r in spark.read.text(f"{path}/plan").collect())}
    wave = 0
    while exists(f"entries/wave={wave}/_SUCCESS"):
        wave += 1
    done = set()
    if wave:
        done = {r[0] for r in spark.read.schema(f"{SCHEMA}, wave int").parquet(f"{path}/entries").where(F.col("wave") < wave).where("entry is null").select("job").distinct().collect()}
    todo = [j for n, j in plan.items() if n not in done]
    left = 0
    for k in range(0, len(todo), wave_jobs):
        part = todo[k : k + wave_jobs]
        scan = spark.read.format(source.name()).options(**options, jobs=json.dumps(part), strict="false", marks="true").load()
        scan.write.mode("overwrite").parquet(f"{path}/entries/wave={wave}")
        left += len(part) - spark.read.schema(SCHEMA).parquet(f"{path}/entries/wave={wave}").where("entry is null").count()
        wave += 1
    return left


def harvested(spark: SparkSession, path: str) -> DataFrame:
    """``year, entry`` of everything stored so far."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/entries/wave=*").where("entry is not null").select("year", "entry")
