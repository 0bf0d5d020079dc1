"""The positional index against the searches that scan texts."""

import random

import pytest
from pyspark.sql import functions as F

from bibliolith.operators import search
from bibliolith.operators.text_index import TextIndex, write_index

SCHEMA = "id string, publication_year int, title string, abstract string, keywords array<string>"
WORDS = ["of", "the", "The", "hoof", "there", "theron", "than", "then", "t-on", "éwith", "with", "withé", "_with", "with_", "WITH,", "covid-19", "on", "ON.", "a  b", "ther", "x\ny", "École", "漢字", "thé n"]


def made(n, seed=1):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=rng.randrange(k)))
    rows = [(f"W{i}", 2015 + i % 3, text(9), text(30), [text(4) for _ in range(rng.randrange(3))]) for i in range(n)]
    rows += [("W900", None, "of the year", None, None), ("W901", 2016, None, None, [None, "of the"]), (None, 2016, "of the", "with the", []), ("W902", 2016, "", " \n", [])]
    return rows + [("W903", 2016, "first of", "x", []), ("W903", 2016, "the second", "y with", [])]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    works = spark.createDataFrame(made(150), SCHEMA).repartition(5).cache()
    path = str(tmp_path_factory.mktemp("index"))
    write_index(works, path, block_docs=16, row_group_bytes=4096)
    return works, TextIndex(spark, path, works), path


def scanned(works, condition):
    return sorted({r["id"] for r in works.where(condition & F.col("id").isNotNull()).select("id").collect()})


def found(df):
    ids = [r["id"] for r in df.collect()]
    assert len(ids) == len(set(ids))
    return sorted(ids)


CASES = [
    ("term", ("with",)), ("term", ("of",)), ("term", ("nothing",)), ("term", ("covid-19",)), ("term", ("WITH",)), ("term", ("École",)), ("term", ("漢字",)), ("term", ("...",)),
    ("phrase", ("of the",)), ("phrase", ("The",)), ("phrase", ("oof ther",)), ("phrase", ("with, the",)), ("phrase", ("a  b",)), ("phrase", ("of the then",)), ("phrase", ("École of",)),
    ("wildcard", ("ther*on",)), ("wildcard", ("th?n",)), ("wildcard", ("*on",)), ("wildcard", ("ther*",)), ("wildcard", ("the*the*on",)), ("wildcard", ("t*n",)), ("wildcard", ("the?on",)), ("wildcard", ("*",)),
    ("near", ("with", "the", 2)), ("near", ("of", ["the", "on"], 0)), ("near", ("with", "with", 1)), ("near", ("ther*", "on", 3)), ("near", ("of the", ["with", "than"], 2)), ("near", ("with", "nothing", 9)),
]


@pytest.mark.parametrize("kind,args", CASES)
def test_searches_equal_the_scan(indexed, kind, args):
    works, index, _ = indexed
    assert found(getattr(index, kind)(*args)) == scanned(works, getattr(search, kind)(*args))


def test_searches_of_one_field(indexed):
    works, index, _ = indexed
    for columns in (("title",), ("abstract",), ("keywords",)):
        assert found(index.term("the", columns)) == scanned(works, search.term("the", columns))
        assert found(index.phrase("of the", columns)) == scanned(works, search.phrase("of the", columns))


def test_many_terms_join_the_dictionary(indexed):
    works, index, _ = indexed
    index = TextIndex(works.sparkSession, indexed[2], works, literal_terms=1)
    assert found(index.phrase("h")) == scanned(works, search.phrase("h"))


def test_a_year_is_indexed_again(spark, tmp_path):
    works = spark.createDataFrame(made(40), SCHEMA)
    path = str(tmp_path / "index")
    write_index(works, path, block_docs=8)
    later = spark.createDataFrame([("N1", 2016, "with nothing", "of the", [])], SCHEMA)
    write_index(later, path, block_docs=8)
    now = works.where("publication_year <> 2016 or publication_year is null").unionByName(later)
    index = TextIndex(spark, path, now)
    for kind, args in (("term", ("with",)), ("phrase", ("of the",)), ("wildcard", ("ther*on",)), ("near", ("with", "the", 2))):
        assert found(getattr(index, kind)(*args)) == scanned(now, getattr(search, kind)(*args))


def test_an_index_of_nothing(spark, tmp_path):
    works = spark.createDataFrame([("W1", 2016, None, "", [])], SCHEMA)
    write_index(works, str(tmp_path / "index"))
    index = TextIndex(spark, str(tmp_path / "index"), works)
    assert found(index.term("a")) == found(index.phrase("a b")) == found(index.near("a", "b", 2)) == []


def test_a_lookup_reads_few_row_groups(spark, tmp_path, scan_rows):
    rng = random.Random(4)
    rows = [(f"W{i}", 2016, "", " ".join(f"t{rng.randrange(6000)}" for _ in range(60)), []) for i in range(600)]
    works = spark.createDataFrame(rows, SCHEMA)
    write_index(works, str(tmp_path / "index"), row_group_bytes=16 << 10)
    index = TextIndex(spark, str(tmp_path / "index"), works)
    everything = index.postings.count()
    hit = index.term("t77")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,t77)" in plan and everything > 5000
    assert found(hit) == scanned(works, search.term("t77")) and 0 < scan_rows(index.term("t77"), "/postings") < everything / 4
    assert "title" not in plan and "abstract" not in plan  # no text is read


def test_a_block_of_long_texts_is_given_in_parts(spark):
    from bibliolith.operators.text_index import _postings

    rows = [(2015, 0, p, 1, "of the " * 40) for p in range(6)] + [(2016, 0, 0, 1, "the end")]
    texts = spark.createDataFrame(rows, "publication_year int, block int, place int, field int, text string").coalesce(1)
    for most in (1, 100, 1 << 20):
        found = _postings(texts, ["p"], {2015: (0, 2), 2016: (2, 2)}, most).collect()
        at = [x for r in found if r["publication_year"] == 2015 and r["term"] == "the" for x in r["at"]]
        assert len(at) == 240 and at == sorted(set(at)) and {r["range"] for r in found if r["term"] == "end"} == {2}
    assert len(found) == 4  # a row a token and block
