from bibliolith.plans import testworks


def test_works_are_moved_and_sorted_before_their_texts_are_made(spark, sf_dir):
    plan = testworks._works(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan  # sets of strings moved with each work
    lines = [line for line in plan.splitlines() if "10.1000/w" in line or line.strip(" +-:").startswith("Sort ")]
    assert "10.1000/w" in lines[0] and "Sort " in lines[-1]


def test_tables_of_periods_are_cut_before_they_are_ranked(spark, sf_dir):
    from bibliolith.operators import reports
    from bibliolith.operators.entities import ENTITIES

    works = testworks.works(spark, sf_dir)
    windows = [(1995, 1997), (1996, 1998)]
    tables = reports.period_tables(works, ENTITIES["organizations_colab"], windows, limit=7, overlap=False)
    found = [(r["period"], r["rank"], r["name"]) for r in tables.collect()]
    wanted = []
    for window, years in zip(windows, ((1995, 1997), (1998, 1998))):
        one = reports.period_table(works, ENTITIES["organizations_colab"], years).where("rank <= 7").collect()
        wanted += [(f"{window[0]}-{window[1]}", r["rank"], r["name"]) for r in one]
    assert sorted(found) == sorted(wanted) and len(found) == 14
    assert "Window [row_number() " in (plan := tables._jdf.queryExecution().executedPlan().toString()) or "row_number()" in plan
    assert plan.count("TakeOrderedAndProject") >= 2  # before, a task ranked all rows of a period


def test_a_matrix_measures_the_names_that_are_kept(spark, sf_dir):
    from bibliolith.operators import reports
    from bibliolith.operators.entities import ENTITIES

    works = testworks.works(spark, sf_dir)
    for slug in ("organizations_colab", "organizations"):
        whole = reports.matrix(works, ENTITIES[slug], [(1995, 1996), (1997, 1998)], limit=None)
        few = reports.matrix(works, ENTITIES[slug], [(1995, 1996), (1997, 1998)], limit=4)
        assert sorted(map(str, few.collect())) == sorted(map(str, whole.where("rank <= 4").select(*few.columns).collect()))
        assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString()  # before, all names were measured
