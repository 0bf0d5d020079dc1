import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibliolith.operators import cubes, reports
from bibliolith.operators.entities import ENTITIES
from bibliolith.operators.indicators import display, indicator_table
from bibliolith.operators.periods import assign_all, assign_first, consecutive_windows, sliding_windows

COLUMNS = (
    "id string, publication_year int, cited_by_count long, fwci double, percentile double, is_top_10 int, is_top_1 int, oa_status string, "
    "source_id string, all_country_codes array<string>, institution_names array<string>, institution_types array<string>, apc_paid_usd double, is_retracted int"
)
ROWS = [
    ("W1", 2019, 12, 2.0, 99.5, 1, 1, "gold", "S1", ["MX", "BR"], ["UA", "UB"], ["education"], 1200.0, 0),
    ("W2", 2019, 0, 0.0, 10.0, 0, 0, "closed", "S1", ["MX"], ["UA"], ["education"], 0.0, 0),
    ("W3", 2020, 5, 1.5, 91.0, 0, 0, "diamond", "S2", ["MX", "US"], ["UA", "UC"], ["education", "company"], 0.0, 0),
    ("W4", 2021, 3, 0.8, 60.0, 0, 0, "green", "S2", ["US"], ["UC"], ["company"], 0.0, 0),
    ("W5", 2021, 10, 1.2, 90.0, 0, 0, "hybrid", "S3", ["BR", "AR", ""], ["UB"], ["education"], 900.5, 0),
    ("W6", 2022, 1, 0.5, 20.0, 0, 0, "bronze", "S3", [], [], [], 0.0, 1),
]


@pytest.fixture(scope="module")
def works(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    zero = F.lit(0)
    return df.select(
        "*",
        (F.col("oa_status") != "closed").cast("int").alias("is_oa"),
        zero.alias("is_doaj_indexed"),
        zero.alias("is_core_journal"),
        zero.alias("is_paratext"),
        F.col("all_country_codes").alias("country_codes"),
    ).cache()


def test_baseline(works):
    row = reports.baseline(works).first().asDict()
    expected = {
        "num_documents": 6, "times_cited": 31, "cites_per_doc": 5.17, "pct_docs_cited": 83.33, "fwci_avg": 1.0, "avg_percentile": 61.8,
        "docs_top_10": 3, "pct_top_10": 50.0, "docs_top_1": 1, "pct_top_1": 16.667, "pct_oa_total": 83.3, "pct_oa_gold": 16.7,
        "pct_international": 50.0, "pct_domestic": 50.0, "pct_industry": 33.3, "pct_global_south": 33.3, "estimated_apc_paid_usd": 2100.5,
        "avg_apc_per_doc_usd": 350.08, "estimated_diamond_savings_usd": 1800.0, "pct_retracted": 16.67, "h_index": 3, "i10_index": 2,
    }
    assert {k: row[k] for k in expected} == expected


def test_locations_drop_nameless_and_break_ties_by_name(works):
    rows = reports.full_table(works, ENTITIES["locations"]).orderBy("rank").collect()
    assert [(r["name"], r["num_documents"], r["times_cited"]) for r in rows] == [("MX", 3, 17), ("BR", 2, 22), ("US", 2, 8), ("AR", 1, 10)]


def test_yearly_growth(works):
    rows = reports.corpus_trend(works).orderBy("publication_year").collect()
    got = [(r["publication_year"], r["num_documents"], r["h_index"], r["docs_growth"], r["cites_growth"]) for r in rows]
    assert got == [(2019, 2, 1, None, None), (2020, 1, 1, -50.0, -58.33), (2021, 2, 2, 100.0, 160.0), (2022, 1, 1, -50.0, -92.31)]


def test_institution_pairs(works):
    rows = reports.full_table(works, ENTITIES["organizations_colab"]).collect()
    assert sorted((r["name"], r["num_documents"]) for r in rows) == [("UA --- UB", 1), ("UA --- UC", 1)]
    assert reports.full_table(works, ENTITIES["organizations_colab"], min_docs=2).isEmpty()


def test_overlapping_periods(works):
    periods = sliding_windows(2019, 2022, 2)
    count = lambda df: {r["period"]: r["count"] for r in df.groupBy("period").count().collect()}
    assert count(assign_all(works, periods)) == {"2019-2020": 3, "2020-2021": 3, "2021-2022": 3}
    assert count(assign_first(works, periods)) == {"2019-2020": 3, "2020-2021": 2, "2021-2022": 1}


def test_consecutive_table_and_matrix(works):
    rows = reports.consecutive_table(works, [(2017, 2018), (2019, 2020), (2021, 2022)]).orderBy("period").collect()
    assert [(r["period"], r["docs_change"]) for r in rows] == [("2019-2020", None), ("2021-2022", 0.0)]
    row = reports.matrix(works, ENTITIES["locations"], [(2017, 2018), (2019, 2020)]).where("name = 'MX'").first()
    assert (row["docs_2017_2018"], row["docs_2019_2020"], row["docs_change_2019_2020"]) == (0, 3, 100.0)


def test_cube_rollup_equals_direct(works):
    cube = cubes.build(works, "countries")
    direct = indicator_table(works.select("*", F.explode("country_codes").alias("country")).where("country <> ''"), ["country"]).drop("h_index")
    assert sorted(cubes.rollup(cube, ["country"]).collect()) == sorted(direct.collect())


def test_cube_years_are_replaced(works, tmp_path):
    path = str(tmp_path / "cube")
    cube = cubes.build(works, "sources")
    cubes.write(cube, path)
    cubes.write(cube.where("publication_year = 2021"), path)
    back = works.sparkSession.read.parquet(path)
    assert back.agg(F.sum("doc_count")).first()[0] == 6


def test_empty_corpus(works):
    none = works.where("false")
    assert reports.baseline(none).isEmpty()
    assert reports.matrix(none, ENTITIES["locations"], [(2019, 2020)]).isEmpty()


def test_display_headings(works):
    table = display(reports.full_table(works, ENTITIES["keywords"]) if "keywords" in works.columns else reports.full_table(works, ENTITIES["locations"]))
    assert table.columns[:4] == ["Name", "Rank", "Documents", "Times Cited"]


@settings(max_examples=12, deadline=None)
@given(counts=st.lists(st.integers(0, 30), min_size=1, max_size=25))
def test_h_index_definition(spark, works, counts):
    base = works.limit(1).drop("cited_by_count")
    rows = base.crossJoin(spark.createDataFrame([(c,) for c in counts], "cited_by_count long"))
    expected = max(h for h in range(len(counts) + 1) if sum(c >= h for c in counts) >= h)
    assert indicator_table(rows, []).first()["h_index"] == expected


@given(start=st.integers(1990, 2010), length=st.integers(0, 30), width=st.integers(1, 9), anchor=st.sampled_from(["start", "end"]))
def test_consecutive_windows_partition_the_range(start, length, width, anchor):
    windows = consecutive_windows(start, start + length, width, anchor)
    years = [y for s, e in windows for y in range(s, e + 1)]
    assert years == list(range(start, start + length + 1))


def test_window_cases():
    assert consecutive_windows(2011, 2025, 5) == [(2011, 2015), (2016, 2020), (2021, 2025)]
    assert consecutive_windows(2012, 2025, 5) == [(2012, 2015), (2016, 2020), (2021, 2025)]
    assert consecutive_windows(2012, 2025, 5, "start") == [(2012, 2016), (2017, 2021), (2022, 2025)]
    assert sliding_windows(2019, 2022, 9) == [(2019, 2022)]
    assert sliding_windows(2022, 2019, 2) == []


def test_trends_of_spread_names_move_narrow_rows_once(works):
    entity = ENTITIES["organizations_colab"]
    several = works.unionAll(works.withColumn("cited_by_count", F.col("cited_by_count") + 2)).unionAll(works.where("id < 'W4'").withColumn("fwci", F.lit(None)))
    found = reports.trend_table(several, entity)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # before, sums of each pair, year and count moved, and then moved again
    wanted = indicator_table(reports.by_entity(several, entity).where("publication_year > 0"), ["name", "publication_year"])
    assert found.columns == wanted.columns and [f.dataType for f in found.schema] == [f.dataType for f in wanted.schema]
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() == 2
