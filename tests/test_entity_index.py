"""The entity index against a scan of the names."""

import random

import pytest
from pyspark.sql import functions as F

from bibliolith.operators.entity_index import EntityIndex, entries_of, write_entity_index
from bibliolith.operators.search import COUNTRY_CODES
from bibliolith.plans import testworks

SCHEMA = "kind string, id string, display_name string, works long"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [("authors", f"A{k}", " ".join("".join(rng.choices("aeinrstÉñ漢", k=rng.randrange(1, 7))) for _ in range(3)), rng.randrange(9)) for k in range(700)]
    rows += [("sources", "S1", "Acta", 5), ("sources", "S2", None, 5), ("sources", "S3", "", 5), ("sources", "S4", "x", 1), ("sources", "S5", "İx", 1)]
    entries = spark.createDataFrame(rows, SCHEMA).cache()
    path = str(tmp_path_factory.mktemp("entities"))
    write_entity_index(entries, path, top=15, row_group_bytes=4 << 10)
    return entries, EntityIndex(spark, path, top=15)


@pytest.mark.parametrize("text", ["a", "É", "ñ漢", "in", "rst", "RST", " tin ", "aei", "asti", "stin r", "s t", "zzzz", "", "_", "%"])
@pytest.mark.parametrize("limit", [10, 50])
def test_equals_a_scan_of_the_names(indexed, text, limit):
    entries, index = indexed
    low = text.strip().lower()
    held = entries.where((F.col("kind") == "authors") & F.contains(F.lower("display_name"), F.lit(low)) & F.lit(low != ""))
    want = held.orderBy(F.desc("works"), "display_name", "id").limit(limit).collect()
    assert [tuple(r) for r in index.search("authors", text, limit).collect()] == [tuple(r) for r in want]


def test_other_kinds_and_few_rows(indexed, scan_rows):
    _, index = indexed
    assert [r["id"] for r in index.search("sources", "act").collect()] == ["S1"] and index.search("nothing", "act").count() == 0
    hit = index.search("authors", "stin")
    assert "entries" not in str(hit.inputFiles()) and scan_rows(hit, "/grams") < index.grams.count() / 3


def test_kinds_of_the_works(spark, sf_dir):
    found = entries_of(testworks.works(spark, sf_dir))
    assert {r["kind"] for r in found.select("kind").distinct().collect()} == {"domains", "fields", "subfields", "topics", "types", "sources", "institutions", "authors", "countries"}
    names = {r["id"]: r["display_name"] for r in found.where("kind = 'countries'").collect()}
    assert names and all(COUNTRY_CODES.get(n.upper(), i) == i for i, n in names.items()) and any(i != n for i, n in names.items())
