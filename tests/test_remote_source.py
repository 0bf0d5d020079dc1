"""Remote data sources over fake transports that fail, count and refuse."""

import json
import os
import time

import pytest

from bibliolith.sources.remote_source import QuotaExceeded, harvest_into, harvested, register, remote_source

PER_YEAR = {2000 + k: 3 + 5 * (k % 4) for k in range(8)}


def fake(log, failing=0, quota=None):
    """A search that notes each request in a file (executors are other processes), fails each job's first ``failing`` attempts
    and refuses after ``quota`` requests."""

    def fetch(query, first, last, start, count):
        with open(log, "a") as out:
            out.write(json.dumps([first, last, start, count, time.time()]) + "\n")
        lines = [json.loads(x) for x in open(log)]
        if quota and sum(x[3] > 0 for x in lines) > quota and not os.path.exists(log + ".more"):
            raise QuotaExceeded
        if count and sum(x[:4] == [first, last, start, count] for x in lines) <= failing:
            raise OSError("gone")
        entries = [{"eid": f"{y}-{k}", "year": y} for y in range(first, last + 1) for k in range(PER_YEAR.get(y, 0))]
        return entries[start : start + count], len(entries)

    return fetch


EVERY = sorted(f"{y}-{k}" for y, n in PER_YEAR.items() for k in range(n))


def eids(df):
    return sorted(json.loads(r["entry"])["eid"] for r in df.select("entry").collect())


def scan(spark, source, **options):
    register(spark, source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load()


OPTIONS = {"query": "q", "start": 2000, "end": 2007, "page": 4, "most": 20, "readers": 3, "backoff": 0}


def test_all_entries_once_in_spite_of_failures(spark, tmp_path):
    source = remote_source("fake_search", fake(str(tmp_path / "log"), failing=2))
    assert eids(scan(spark, source, **OPTIONS)) == EVERY
    with pytest.raises(Exception, match="gone"):
        scan(spark, source, **OPTIONS | {"query": "again", "retries": 0, "page": 5}).collect()


def test_years_are_pushed_into_the_requests(spark, tmp_path):
    log = str(tmp_path / "log")
    source = remote_source("fake_years", fake(log))
    got = scan(spark, source, **OPTIONS).where("year >= 2003 and year < 2005")
    assert eids(got) == [e for e in EVERY if e[:4] in ("2003", "2004")]
    assert {y for x in map(json.loads, open(log)) for y in x[:2]} <= {2003, 2004}


def test_the_rate_holds_over_all_readers(spark, tmp_path):
    log = str(tmp_path / "log")
    assert eids(scan(spark, remote_source("fake_rate", fake(log)), **OPTIONS | {"rate": 8})) == EVERY
    times = sorted(x[4] for x in map(json.loads, open(log)) if x[3] > 0)
    assert len(times) > 20 and (len(times) - 3) / (times[-1] - times[0]) <= 8.5  # each reader's first is free


def test_ids_go_in_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def records(ids):
        with open(log, "a") as out:
            out.write(f"{len(ids)}\n")
        return [{"eid": i, "year": None} for i in ids]

    ids = [f"P{k}" for k in range(1203)]
    got = scan(spark, remote_source("fake_ids", records=records), ids=",".join(ids + ids[:5]), readers=2)
    assert eids(got) == sorted(ids) and sorted(map(int, open(log))) == [203, 500, 500]


def test_a_harvest_goes_on_where_it_stopped(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "out")
    source = remote_source("fake_quota", fake(log, quota=9))
    left = harvest_into(spark, source, path, wave_jobs=2, **OPTIONS)
    some = eids(harvested(spark, path))
    assert left > 0 and 0 < len(some) < len(EVERY) and len(set(some)) == len(some)
    open(log + ".more", "w").close()  # the quota is given anew
    asked = len(list(open(log)))
    assert harvest_into(spark, source, path, wave_jobs=2, **OPTIONS) == 0
    assert eids(harvested(spark, path)) == EVERY
    assert harvest_into(spark, source, path, wave_jobs=2, **OPTIONS) == 0  # nothing is open, nothing is asked
    again = [x for x in map(json.loads, list(open(log))[asked:])]
    assert len({(x[0], x[1], x[2]) for x in again}) == len(again) and eids(harvested(spark, path)) == EVERY
