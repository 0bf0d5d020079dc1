"""Cubes with histograms, and cubes of works that come again."""

import random

import pytest
from pyspark.sql import functions as F

from bibliolith.operators import cubes
from bibliolith.operators.entities import MEASURED
from bibliolith.operators.indicators import indicator_table
from bibliolith.plans import testworks
from bibliolith.streaming.cubes import fold, folded_up_to, maintain_corrected, read_corrected


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    names = list(dict.fromkeys(["id", *MEASURED, "country_codes", "topic_id", "institution_names", "source_id"]))
    return testworks.works(spark, sf_dir).select(*names, F.lit(1).alias("version")).cache()


@pytest.mark.parametrize("cube", list(cubes.CUBES))
def test_reports_of_any_years_equal_the_indicators_of_the_works(rows, cube):
    keys = list(cubes.CUBES[cube])
    stored = cubes.build(rows, cube, histogram=True).cache()
    for years in ((1992, 1998), (1995, 1995), (1993, 1996)):
        direct = indicator_table(cubes.keyed(rows.where(F.col("publication_year").between(*years)), cube), keys)
        got = cubes.report(stored, keys, years)
        assert got.columns == direct.columns and "h_index" in got.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, direct.collect()))


def test_merged_cells_report_the_same(rows):
    stored = cubes.build(rows, "topics", histogram=True)
    by_topic = cubes.merge(stored, ["topic"])
    again = cubes.report(by_topic, ["topic"])
    assert sorted(map(str, again.collect())) == sorted(map(str, cubes.report(stored, ["topic"]).collect()))
    assert cubes.report(stored.where("false"), ["topic"]).count() == 0


def cells(df):
    return sorted(str([r[c] if not isinstance(r[c], float) else round(r[c], 6) for c in sorted(df.columns)]) for r in df.collect())


def test_corrected_works_equal_a_rebuild(spark, rows, tmp_path):
    """Batches bring works again with other citations, years and countries, late old states, repeated rows and null ids."""
    rng = random.Random(8)
    source, path, check = (str(tmp_path / n) for n in ("in", "cube", "check"))
    sample = rows.limit(120)
    listed = [r.asDict() for r in sample.collect()]
    last = {}
    unnamed = []

    def run(batch):
        frame = spark.createDataFrame(batch, rows.schema).coalesce(1)
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        maintain_corrected(stream, "countries", path, check, version="version", fold_every=2).awaitTermination()

    for turn in range(5):
        batch = []
        for row in rng.sample(listed, 50):
            version = turn * 10 + rng.randrange(5)
            changed = row | {"cited_by_count": rng.randrange(40), "publication_year": 1995 + rng.randrange(3), "country_codes": rng.sample(["MX", "BR", "US"], rng.randrange(3)), "version": version}
            batch.append(changed)
            last[row["id"]] = changed
        if turn:  # a state older than the known one comes late
            known = rng.choice([k for k in last if last[k] not in batch])
            batch.append(last[known] | {"cited_by_count": 999, "version": -1})
        extra = listed[1] | {"id": None, "country_codes": ["MX"]}
        unnamed += [extra]
        run(batch + batch[:3] + [extra])
        state = [*last.values(), *unnamed]
        want = cubes.build(spark.createDataFrame(state, rows.schema), "countries", histogram=True)
        assert cells(read_corrected(spark, "countries", path)) == cells(want), turn
    assert folded_up_to(spark, path) == 4
    before = cells(read_corrected(spark, "countries", path))
    fold(spark, "countries", path, 4)
    assert cells(read_corrected(spark, "countries", path)) == before


def test_a_repeated_batch_counts_once(spark, rows, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "cube")
    for turn in range(3):
        rows.limit(40).withColumn("cited_by_count", F.lit(turn + 5)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        maintain_corrected(stream, "sources", path, str(tmp_path / f"check{turn}")).awaitTermination()  # from the first batch on, again
    got = read_corrected(spark, "sources", path)
    assert got.agg(F.sum("doc_count")).first()[0] == 40


def test_sums_do_not_move_with_the_counts_of_citations(rows):
    built = cubes.build(rows, "institutions", histogram=True)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    counts = [line for line in plan.splitlines() if "Aggregate [institution" in line and line.split("], [")[0].count("#") == 3]
    assert counts and not any("fwci_sum" in line for line in counts)  # before, all sums moved for each count of citations
    assert built.columns == [*cubes.build(rows, "institutions").columns, "citations"]
    both = cubes.report(built, ["institution"])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in both


def test_states_are_folded_when_they_have_doubled(spark, rows, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "cube")
    for turn in range(3):
        rows.where(F.xxhash64("id") % 3 == turn - 1).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        maintain_corrected(stream, "sources", path, str(tmp_path / "check"), fold_every=1).awaitTermination()
    assert folded_up_to(spark, path) == 2
    assert [p.name for p in (tmp_path / "cube").glob("works-*")] == ["works-1"]  # before, each folding rewrote all states
    assert (tmp_path / "cube" / "states" / "batch=2").exists()


def test_a_batch_is_read_once_and_only_what_it_needs(spark, rows, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "cube")
    for turn in range(2):
        rows.where(F.xxhash64("id") % 2 == 0).withColumn("cited_by_count", F.lit(turn + 5)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream = stream.withColumn("abstract", F.when(F.col("id").isNotNull(), F.raise_error(F.lit("not needed"))))
    query = maintain_corrected(stream, "countries", path, str(tmp_path / "check"), version="version")
    query.awaitTermination()  # before, every column of the stream was made
    count = rows.where(F.xxhash64("id") % 2 == 0).count()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [count, count]  # before, about three times as many
    last = rows.where(F.xxhash64("id") % 2 == 0).withColumn("cited_by_count", F.lit(6).cast("long"))
    assert cells(read_corrected(spark, "countries", path)) == cells(cubes.build(last, "countries", histogram=True))
