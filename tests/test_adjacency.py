"""Neighbour lists against the edges, and pairs of institutions in blocks."""

import random

from pyspark.sql import functions as F

from bibliolith.operators import citations, pairs, reports
from bibliolith.operators.adjacency import Adjacency, write_adjacency
from bibliolith.operators.entities import ENTITIES
from bibliolith.plans import testworks

EDGES = "cited_work_id string, citing_work_id string, citing_publication_year int"


def made(hub=3000):
    rng = random.Random(6)
    rows = [(f"W{rng.randrange(400)}", f"W{rng.randrange(4000)}", 2000 + rng.randrange(9)) for _ in range(4000)]
    rows += [("W7", f"W{k}", 2010) for k in range(hub)] + [(None, "W1", 2000), ("W1", None, 2000)]
    whole = {(a, b): y for a, b, y in rows}
    return [(a, b, y) for (a, b), y in whole.items()]


def ids(df):
    found = [r[0] for r in df.collect()]
    assert len(found) == len(set(found))
    return sorted(found)


def test_lists_equal_the_edges(spark, tmp_path):
    edges = spark.createDataFrame(made(), EDGES).where("cited_work_id is not null and citing_work_id is not null").cache()
    path = str(tmp_path / "lists")
    write_adjacency(spark.createDataFrame(made() + made()[:50], EDGES), path, part_size=200)
    for literal in (64, 2):
        lists = Adjacency(spark, path, literal_ids=literal)
        for wanted in (["W7"], ["W1", "W2", None, "W2", "W99999"], [], [f"W{k}" for k in range(50)]):
            corpus = spark.createDataFrame([(w,) for w in wanted], "id string")
            assert ids(lists.citing_ids(corpus)) == ids(citations.citing_ids(corpus, edges))
            assert ids(lists.referenced_ids(corpus)) == ids(citations.referenced_ids(corpus, edges))
            assert sorted(lists.yearly_citations(corpus).collect()) == sorted(citations.yearly_citations(corpus, edges).collect())


def test_a_hub_is_cut_into_parts(spark, tmp_path):
    write_adjacency(spark.createDataFrame(made(), EDGES), str(tmp_path / "lists"), part_size=200)
    parts = Adjacency(spark, str(tmp_path / "lists")).lists["cited"].where("work = 'W7'").select(F.size("neighbours")).collect()
    assert len(parts) >= 15 and max(r[0] for r in parts) < 300


def test_one_work_reads_few_lists(spark, tmp_path, scan_rows):
    rows = [(f"W{k:05}", f"W{k * 7 % 9000}", 2000) for k in range(9000)]
    write_adjacency(spark.createDataFrame(rows, EDGES), str(tmp_path / "lists"), row_group_bytes=4 << 10)
    lists = Adjacency(spark, str(tmp_path / "lists"))
    hit = lists.citing_ids(spark.createDataFrame([("W00077",)], "id string"))
    assert ids(hit) == ["W539"] and 0 < scan_rows(hit, "/cited") < 9000 / 4


def test_pairs_in_blocks_equal_those_of_whole_works(spark, sf_dir):
    works = testworks.works(spark, sf_dir)
    own = pairs.institution_pairs(works, ["id"], block=2).select("id", F.concat_ws(pairs.BETWEEN, "a", "b").alias("pair"))
    whole = works.select("id", F.explode(ENTITIES["organizations_colab"].key()).alias("pair"))
    assert sorted(own.collect()) == sorted(whole.collect())
    for limit in (7, 5000):
        want = reports.full_table(works, ENTITIES["organizations_colab"], limit=limit)
        got = pairs.pair_table(works, limit=limit, block=3).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_work_of_3000_institutions_is_dealt_over_tasks(spark):
    works = spark.createDataFrame([("W1", [f"I{k:04}" for k in range(3000)]), ("W2", ["a", "a", ""]), ("W3", None), ("W4", ["b", "a"])], "id string, institution_names array<string>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = pairs.institution_pairs(works, ["id"])
        by_task = {r[0]: r[1] for r in made.where("id = 'W1'").groupBy(F.spark_partition_id()).count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(by_task.values()) == 3000 * 2999 // 2 and len(by_task) >= 4 and max(by_task.values()) < 3_000_000
    assert [tuple(r) for r in made.where("id <> 'W1'").collect()] == [("W4", "a", "b")]


def test_edges_move_once_to_be_made_and_once_a_direction(spark, sf_dir, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = testworks._edges(spark, sf_dir)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange ") == 2  # lines and orders; before, strings of the edges moved again to be made distinct
    write_adjacency(rows.union(rows), str(tmp_path / "lists"))
    got = Adjacency(spark, str(tmp_path / "lists")).lists["citing"].select("work", F.inline("neighbours"))
    assert sorted(map(tuple, got.collect())) == sorted((r[1], r[0], r[2]) for r in rows.collect())
    assert sorted(p.name for p in (tmp_path / "lists").iterdir()) == ["cited", "citing"]


def test_tables_of_pairs_measure_those_that_are_kept(spark, sf_dir):
    works = testworks.works(spark, sf_dir)
    table = pairs.pair_table(works, limit=5)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # before, all pairs were measured by hashes of their names
    want = reports.full_table(works, ENTITIES["organizations_colab"], limit=None).where("rank <= 5")
    assert sorted(map(str, table.collect())) == sorted(map(str, want.select(*table.columns).collect()))
    assert pairs.pair_table(works, min_docs=10**6, limit=5).isEmpty()
