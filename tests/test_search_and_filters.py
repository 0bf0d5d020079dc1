import pytest

from bibliolith.operators import search as q
from bibliolith.operators.filters import filter_works, has_other_entities

ROWS = [
    (1, "Lung cancer in Mexico", "The alveolar cells of the lung", ["asthma"], ["MX"], 2020),
    (2, "Plunge pools", "water COVID-19 O'Brien", ["C++"], ["US"], 2021),
    (3, None, "pulmonary tissue next to alveoli", None, None, 2022),
    (4, "Asthma", "nothing here", [], ["MX", "US"], 2023),
]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(
        ROWS, "id int, title string, abstract string, keywords array<string>, all_country_codes array<string>, publication_year int"
    ).cache()


def ids(works, condition):
    return sorted(r["id"] for r in works.where(condition).collect())


def test_terms_and_wildcards(works):
    assert ids(works, q.topic("lung")) == [1]
    assert ids(works, q.topic("lung*")) == [1, 2]  # patterns are unanchored: "Plunge" has it
    assert ids(works, q.topic("*lung*")) == [1, 2]
    assert ids(works, q.topic("al*lar")) == [1]
    assert ids(works, q.topic("ti*")) == [3]  # a short root is anchored to a word
    assert ids(works, q.wildcard("lun*")) == [1, 2]
    assert ids(works, q.topic("asthma")) == [1, 4]
    assert ids(works, q.topic("C++")) == [2]
    assert ids(works, q.topic("COVID-19")) == [2]
    assert ids(works, q.topic("O'Brien")) == [2]


def test_fields_and_booleans(works):
    assert ids(works, q.title("asthma")) == [4]
    assert ids(works, q.country("Mexico")) == [1, 4]
    assert ids(works, q.topic("asthma") & ~q.country("United States")) == [1]
    assert ids(works, ~q.topic("lung")) == [2, 3, 4]
    assert ids(works, q.topic("nowhere") | q.country("Mexico")) == [1, 4]
    assert ids(works, q.years("2021-2022")) == [2, 3]
    assert ids(works, q.years("soon")) == [1, 2, 3, 4]


def test_near_in_either_order(works):
    assert ids(works, q.near("alveol*", ["lung*", "pulmonary"], 5)) == [1, 3]
    assert ids(works, q.near("alveol*", "lung", 1)) == []
    assert ids(works, q.near("lung", "cells", 3)) == [1]


def test_filter_keeps_the_callers_lists(spark):
    works = spark.createDataFrame([("W1", 2000, ["https://openalex.org/I1"]), ("W2", 2001, ["I2"])], "id string, publication_year int, institution_ids array<string>")
    given = {"institution_ids": ["I1"], "institution_id": "I2"}
    assert filter_works(works, given).count() == 2
    assert given == {"institution_ids": ["I1"], "institution_id": "I2"}
    assert filter_works(works, {**given, "institution_logic": "AND"}).count() == 0
    assert filter_works(works, {"institution_id": "https://openalex.org/I1"}).count() == 1
    assert has_other_entities({"country_codes": ["MX"]}) and not has_other_entities({"start_year": 1})


def test_every_country_and_category(spark):
    assert len(q.COUNTRY_CODES) >= 112 and all(len(c) == 2 for c in q.COUNTRY_CODES.values()) and len(q.CATEGORIES) == 39
    told = {"Algeria": "DZ", "Bangladesh": "BD", "Estonia": "EE", "Iceland": "IS", "Iraq": "IQ", "MEX": "MX", "UAE": "AE", "Slovakia": "SK", "Slovenia": "SI", "fr": "FR"}
    df = spark.createDataFrame([(c, [c]) for c in told.values()], "c string, all_country_codes array<string>")
    for name, code in told.items():
        assert [r[0] for r in df.where(q.country(name)).collect()] == [code]
    rows = [("Pulmonology", "Medicine", ""), ("x", "Medicine", "Lung disease"), ("x", "Chemistry", "Lung disease"), ("Equine", "x", ""), ("x", "Large veterinary", ""), ("x", "y", "Avian flu")]
    df = spark.createDataFrame(rows, "subfield_name string, field_name string, topic string")
    found = lambda c: [k for k, r in enumerate(rows) if tuple(r) in {tuple(x) for x in df.where(q.category(c)).collect()}]
    assert found("Respiratory System") == [0, 1] and found("Veterinary Sciences") == [3, 4] and found("ornithology") == [5]
