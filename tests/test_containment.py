"""A proof of containment against the filters themselves."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bibliolith.operators.containment import answer, contains, from_sources_cube
from bibliolith.operators.filters import WorkFilter

SCHEMA = (
    "id int, publication_year int, is_oa int, oa_status string, type string, source_id string, domain_name string, country_code string, "
    "country_codes array<string>, all_country_codes array<string>, topic_id string, all_topics array<string>, institution_ids array<string>, "
    "author_ids array<string>, title string, is_doaj_indexed int, is_core_journal int"
)
SUBSETS = [list(c) for n in range(3) for c in itertools.combinations("ABC", n)]


def made():
    rows = []
    for k in range(240):
        some = SUBSETS[k % 7]
        rows.append((k, 1998 + k % 5, k % 2, ("gold", "green", None)[k % 3], ("article", "book", None)[k // 2 % 3], "ABC"[k // 3 % 3], ("A", "B", None)[k // 5 % 3], ("A", "B", "C", None)[k // 7 % 4], some if k % 11 else None, SUBSETS[k // 4 % 7], "ABC"[k // 6 % 3], SUBSETS[k // 8 % 7], SUBSETS[k // 9 % 7], SUBSETS[k // 10 % 7], ("red bird", "bird", "Red", None)[k // 12 % 4], k // 13 % 2, k // 17 % 2))
    return rows


values = st.sampled_from([[], ["A"], ["B"], ["A", "B"], "A,C", ["A", "B", "C"]])
logic = st.sampled_from(["OR", "and", None])
filters = st.fixed_dictionaries(
    {},
    optional={
        "start_year": st.integers(1997, 2003), "end_year": st.integers(1997, 2003), "is_oa": st.sampled_from([None, 1, "true", 0]), "oa_status": st.sampled_from(["", "gold", "ALL", "Green"]),
        "work_types": st.sampled_from([[], ["article"], ["Article", "book"], ["all"]]), "source_ids": values, "domains": values, "country_codes": values, "country_logic": logic, "topic_ids": values, "topic_logic": logic,
        "institution_ids": values, "institution_logic": logic, "author_ids": values, "query": st.sampled_from(["", "bird", "Red Bird", "red"]), "is_doaj": st.booleans(), "is_core": st.booleans(),
    },
)


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(made(), SCHEMA).coalesce(1).cache()


@settings(max_examples=40, deadline=None)
@given(st.lists(filters, min_size=6, max_size=6))
def test_never_a_false_yes(works, several):
    compiled = WorkFilter(works)
    flags = works.select(*[compiled.condition(f).alias(f"f{k}") for k, f in enumerate(several)]).collect()
    picked = [{n for n, row in enumerate(flags) if row[k]} for k in range(len(several))]
    for (i, outer), (j, inner) in itertools.product(enumerate(several), repeat=2):
        if contains(outer, inner):
            assert picked[j] <= picked[i], (outer, inner)
        if i == j:
            assert contains(outer, inner)


def test_what_it_proves():
    assert contains({"start_year": 1990, "country_codes": "MX,BR"}, {"start_year": 1995, "end_year": 1999, "country_codes": ["mx"], "is_oa": 1})
    assert contains({"topic_ids": ["T1", "T2"]}, {"topic_ids": ["T2", "T3"], "topic_logic": "AND"})
    assert contains({"topic_ids": ["T1"], "topic_logic": "AND"}, {"topic_ids": ["https://x/T1"]})
    assert not contains({"topic_ids": ["T1", "T2"], "topic_logic": "AND"}, {"topic_ids": ["T1", "T2"]})
    assert not contains({"source_ids": ["S1"]}, {}) and not contains({"query": "red bird"}, {"query": "bird"})
    stored = {"all": ({}, 1000), "mx": ({"country_codes": ["MX"]}, 10), "br": ({"country_codes": ["BR"]}, 5)}
    assert answer(stored, {"country_codes": ["MX"], "start_year": 2000}) == "mx" and answer(stored, {}) == "all"
    assert answer({"mx": stored["mx"]}, {}) is None


def test_the_cube_answers_only_what_it_can(spark):
    cube = spark.createDataFrame([("S1", 2000)], "source string, publication_year int")
    assert from_sources_cube(cube, {"source_ids": ["S1"], "is_oa": 1}) is None and from_sources_cube(cube, {"start_year": 2000}) is None


def test_the_answer_is_read_from_the_kept_corpus(spark, sf_dir):
    import __spark_entry__ as entry

    files = entry.queries()["corpus_coverage_check"](spark, sf_dir).inputFiles()
    assert files and all("corpus_wide" in f for f in files)
