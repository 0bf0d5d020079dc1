import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICKED = ["entity_locations_full", "entity_sector_types_matrix", "entity_funding_agencies_trend", "agg_cube_rollup", "join_citing", "wos_near", "doc_table", "norm_numeric", "flatten_work"]


def same(value):
    return "" if value is None or value != value else f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(same, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "bibliolith", tmp_path / "bibliolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_table' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_prune(spark, sf_dir):
    """Registered queries read what they need from the stored tables."""
    queries = entry.queries()
    plan = plan_of(queries["scan_works"](spark, sf_dir))
    assert "EqualTo(publication_year,1998)" in plan and "abstract" not in plan and "InMemoryRelation" not in plan
    plan = plan_of(queries["agg_cube_rollup"](spark, sf_dir))
    assert "PartitionFilters" in plan and "publication_year" in plan.split("PartitionFilters")[1][:200] and "works/" not in plan
    plan = plan_of(queries["filter_combined"](spark, sf_dir))
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
