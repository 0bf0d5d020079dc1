"""Works, dimensions and citation edges derived from the star-schema test tables, for Spark and as SQL.

One work an order that has a line: its suppliers stand for institutions (their nations for countries),
its parts for authors and topics, its customer for the source and the research area.  All measures are
whole numbers or multiples of powers of two, so sums don't depend on their order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cubes
from ..operators.adjacency import Adjacency, write_adjacency
from ..operators.entity_index import EntityIndex, entries_of, write_entity_index
from ..operators.text_index import TextIndex, write_index
from ..session import delete_with_the_driver, shared_folder

# 15 countries of the Global South, then 10 others, by nation key.
COUNTRIES = "MX BR AR CL CO PE ZA EG NG KE IN ID PK VN TH US GB DE FR ES IT JP CA AU CN".split()
SECTORS = ("education", "company", "government", "healthcare", "nonprofit")
ROUTES = {"1-URGENT": "gold", "2-HIGH": "hybrid", "3-MEDIUM": "green", "4-NOT SPECIFIED": "diamond", "5-LOW": "closed"}
TYPES = ("article", "review", "book-chapter", "letter")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

_STORED: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_at(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Where a corpus, for which these stand, keeps something: ``write(path)`` makes it once an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        root = f"{shared_folder(spark)}/bibliolith-works-{uuid.uuid4().hex}"
        delete_with_the_driver(spark, root)
        write(f"{root}/{name}")
        _STORED[key] = f"{root}/{name}"
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str, name: str, write) -> DataFrame:
    return spark.read.parquet(stored_at(spark, sf_dir, name, write))


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of the year inside each partition."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    suppliers, parts = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    # Narrow rows move, and are sorted before titles and lists of names are made of them.
    detail = (
        lines.select("l_orderkey", "l_suppkey", "l_partkey")
        .join(parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
        .select(F.col("l_orderkey").alias("k"), "l_suppkey", (F.col("l_partkey") % 25).cast("int").alias("topic"), "brand")
        .join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"), "l_suppkey")
    )
    # Dealt first: orders are too many for their lines to meet before they move.
    lists = detail.repartition("k").groupBy("k").agg(F.collect_list(F.struct("s_name", "l_suppkey", "s_nationkey", "topic", "brand")).alias("lines"))

    def names(value):
        return F.sort_array(F.array_distinct(F.array_compact(F.transform("lines", value))))  # as a set is collected: without nulls

    firsts = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").cast("long").alias("cited_by_count"), F.min("l_partkey").alias("p_partkey"))
    titled = firsts.join(parts.select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey")
    who = (
        customers.select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
        .join(nations, "n_nationkey")
        .join(regions.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
        .select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "n_name", "r_name")
    )
    k = F.col("k")
    ordered = orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").join(who, "o_custkey")
    base = ordered.join(titled, "k").join(lists, "k").withColumn("publication_year", F.year("o_orderdate")).sortWithinPartitions("publication_year")
    base = base.select(
        "*",
        names(lambda x: _pick(COUNTRIES, x.s_nationkey)).alias("country_codes"),
        names(lambda x: F.struct(x.s_name.alias("s_name"), x.l_suppkey.alias("l_suppkey"))).alias("suppliers"),  # one order for the three lists
        names(lambda x: _pick(SECTORS, x.l_suppkey % 5)).alias("institution_types"),
        names(lambda x: F.concat(F.lit("Author "), x.brand)).alias("author_names"),
        names(lambda x: F.concat(F.lit("A"), F.substring(x.brand, 7, 9))).alias("author_ids"),
        names(lambda x: F.concat(F.lit("T"), x.topic)).alias("all_topics"),
    )
    route = F.when(F.col("o_orderstatus") == "P", "bronze")
    for priority, name in ROUTES.items():
        route = route.when(F.col("o_orderpriority") == priority, name)
    flag = lambda condition: condition.cast("int")
    sdg = lambda n: F.concat(F.lit("https://metadata.un.org/sdg/"), n.cast("string"))
    paid = F.col("oa_status").isin("gold", "hybrid")
    return base.withColumn("oa_status", route).select(
        F.concat(F.lit("W"), k).alias("id"),
        F.concat(F.lit("10.1000/w"), k).alias("doi"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"),
        F.concat_ws(" ", "p_type", F.lit("of the"), "p_name", F.lit("from"), "c_mktsegment").alias("abstract"),
        _pick(TYPES, k % 4).alias("type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        "publication_year",
        "cited_by_count",
        ((k % 977).cast("double") / 512).alias("fwci"),
        ((k * 37 % 801).cast("double") / 8).alias("percentile"),
        flag(k % 50 == 0).alias("is_top_10"),
        flag(k % 500 == 0).alias("is_top_1"),
        flag(F.col("oa_status") != "closed").alias("is_oa"),
        "oa_status",
        flag(k % 3 == 0).alias("is_doaj_indexed"),
        flag(k % 7 == 0).alias("journal_is_in_doaj"),
        flag(k % 4 == 0).alias("is_core_journal"),
        flag(k % 11 == 0).alias("journal_is_core"),
        flag(k % 97 == 0).alias("is_retracted"),
        flag(k % 89 == 0).alias("is_paratext"),
        F.concat(F.lit("S"), "o_custkey").alias("source_id"),
        F.col("c_name").alias("source_name"),
        "author_names",
        "author_ids",
        F.col("suppliers.s_name").alias("institution_names"),
        F.transform("suppliers", lambda x: F.concat(F.lit("I"), x.l_suppkey)).alias("institution_ids"),
        F.transform("suppliers", lambda x: F.concat(F.lit("ror"), x.l_suppkey)).alias("institution_rors"),
        "institution_types",
        "country_codes",
        F.col("country_codes").alias("all_country_codes"),
        F.element_at("country_codes", 1).alias("country_code"),
        F.col("r_name").alias("domain_name"),
        F.col("n_name").alias("field_name"),
        F.col("p_type").alias("subfield_name"),
        F.col("p_brand").alias("topic"),
        F.concat(F.lit("T"), F.col("p_partkey") % 25).alias("topic_id"),
        "all_topics",
        F.when(k % 5 == 0, F.array(sdg(k % 17 + 1), sdg(k % 13 + 1))).otherwise(F.array(sdg(k % 17 + 1))).alias("sdgs"),
        F.array_distinct(F.array("p_type", "c_mktsegment")).alias("concepts"),
        F.split("p_name", " ").alias("keywords"),
        F.when(k % 3 == 0, F.array("c_mktsegment", "r_name")).otherwise(F.array("c_mktsegment")).alias("funder_names"),
        F.when(paid, (k % 400).cast("double") * 10).otherwise(F.lit(0.0)).alias("apc_paid_usd"),
        ((k % 300).cast("double") * 10).alias("apc_list_usd"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by year inside its files, so that a range of years skips row groups."""
    return stored(spark, sf_dir, "works", lambda path: _works(spark, sf_dir).write.option("compression", "zstd").parquet(path))


def cube(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A cube as it is kept, in a folder for each year."""
    return stored(spark, sf_dir, f"cube_{name}", lambda path: cubes.write(cubes.build(works(spark, sf_dir), name, histogram=True), path))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_orderkey")).first()[0]
    pairs = lines.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") * 7 % top + 1).alias("b"))
    dated = pairs.join(orders.select(F.col("o_orderkey").alias("a"), F.year("o_orderdate").alias("citing_publication_year")), "a")
    # Numbers are made distinct where the lines of an order met; strings of them would move again.
    return dated.where("a <> b").distinct().select(
        F.concat(F.lit("W"), "b").alias("cited_work_id"), F.concat(F.lit("W"), "a").alias("citing_work_id"), "citing_publication_year"
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt and sorted by the cited work, so that a lookup reads few row groups."""
    return stored(
        spark, sf_dir, "edges", lambda path: _edges(spark, sf_dir).repartition("cited_work_id").sortWithinPartitions("cited_work_id").write.parquet(path)
    )


def adjacency(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The edges as neighbour lists of both directions."""
    return Adjacency(spark, stored_at(spark, sf_dir, "adjacency", lambda path: write_adjacency(_edges(spark, sf_dir), path)))


def entity_index(spark: SparkSession, sf_dir: str) -> EntityIndex:
    """The names that the works speak of, by their parts."""
    return EntityIndex(spark, stored_at(spark, sf_dir, "entities", lambda path: write_entity_index(entries_of(works(spark, sf_dir)), path)))


def text_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works: the first line is the title, the whole text the abstract."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("D"), "doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.array("lang", "source").alias("keywords"),
        (F.col("doc_id") % 10 + 2015).cast("int").alias("publication_year"),
        F.array(_pick(COUNTRIES, F.col("doc_id") % 25)).alias("all_country_codes"),
        F.concat(F.lit("Journal "), "source").alias("source_name"),
        _pick(("Medicine", "Chemistry", "Nursing", "Mathematics"), F.col("doc_id") % 4).alias("field_name"),
        _pick(("Pulmonology", "Surgery", "Oncology"), F.col("doc_id") % 3).alias("subfield_name"),
        F.lit("lung and bird research").alias("topic"),
    )


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of ``text_works``, as it is kept."""
    rows = text_works(spark, sf_dir)
    return TextIndex(spark, stored_at(spark, sf_dir, "text_index", lambda path: write_index(rows, path)), rows)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


WORKS_SQL = f"""
WITH lists AS (
  SELECT l_orderkey AS k, CAST(sum(l_quantity) AS BIGINT) AS cited_by_count, min(l_partkey) AS p_partkey,
    list_sort(list(DISTINCT {_list(COUNTRIES)}[s_nationkey + 1])) AS country_codes,
    list_sort(list(DISTINCT {{'n': s_name, 's': l_suppkey}})) AS suppliers,
    list_sort(list(DISTINCT {_list(SECTORS)}[l_suppkey % 5 + 1])) AS institution_types,
    list_sort(list(DISTINCT 'Author ' || p_brand)) AS author_names,
    list_sort(list(DISTINCT 'A' || substr(p_brand, 7, 9))) AS author_ids,
    list_sort(list(DISTINCT 'T' || (l_partkey % 25))) AS all_topics
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
based AS (
  SELECT lists.*, o.*, p_name, p_type, p_brand, c_name, c_mktsegment, n_name, r_name,
    CASE WHEN o_orderstatus = 'P' THEN 'bronze' {' '.join(f"WHEN o_orderpriority = '{p}' THEN '{r}'" for p, r in ROUTES.items())} END AS oa_status
  FROM orders o JOIN lists ON lists.k = o_orderkey JOIN part p ON p.p_partkey = lists.p_partkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
works AS (
  SELECT 'W' || k AS id, '10.1000/w' || k AS doi, p_name || ' ' || p_type || ' ' || p_brand AS title,
    p_type || ' of the ' || p_name || ' from ' || c_mktsegment AS abstract, {_list(TYPES)}[k % 4 + 1] AS type,
    strftime(o_orderdate, '%Y-%m-%d') AS publication_date, CAST(year(o_orderdate) AS INTEGER) AS publication_year, cited_by_count,
    CAST(k % 977 AS DOUBLE) / 512 AS fwci, CAST(k * 37 % 801 AS DOUBLE) / 8 AS percentile,
    CAST(k % 50 = 0 AS INTEGER) AS is_top_10, CAST(k % 500 = 0 AS INTEGER) AS is_top_1,
    CAST(oa_status <> 'closed' AS INTEGER) AS is_oa, oa_status,
    CAST(k % 3 = 0 AS INTEGER) AS is_doaj_indexed, CAST(k % 7 = 0 AS INTEGER) AS journal_is_in_doaj,
    CAST(k % 4 = 0 AS INTEGER) AS is_core_journal, CAST(k % 11 = 0 AS INTEGER) AS journal_is_core,
    CAST(k % 97 = 0 AS INTEGER) AS is_retracted, CAST(k % 89 = 0 AS INTEGER) AS is_paratext,
    'S' || o_custkey AS source_id, c_name AS source_name, author_names, author_ids,
    list_transform(suppliers, lambda x: x.n) AS institution_names, list_transform(suppliers, lambda x: 'I' || x.s) AS institution_ids,
    list_transform(suppliers, lambda x: 'ror' || x.s) AS institution_rors, institution_types, country_codes, country_codes AS all_country_codes, country_codes[1] AS country_code,
    r_name AS domain_name, n_name AS field_name, p_type AS subfield_name, p_brand AS topic, 'T' || (p_partkey % 25) AS topic_id, all_topics,
    CASE WHEN k % 5 = 0 THEN ['https://metadata.un.org/sdg/' || (k % 17 + 1), 'https://metadata.un.org/sdg/' || (k % 13 + 1)]
         ELSE ['https://metadata.un.org/sdg/' || (k % 17 + 1)] END AS sdgs,
    list_distinct([p_type, c_mktsegment]) AS concepts, string_split(p_name, ' ') AS keywords,
    CASE WHEN k % 3 = 0 THEN [c_mktsegment, r_name] ELSE [c_mktsegment] END AS funder_names,
    CASE WHEN oa_status IN ('gold', 'hybrid') THEN CAST(k % 400 AS DOUBLE) * 10 ELSE 0.0 END AS apc_paid_usd,
    CAST(k % 300 AS DOUBLE) * 10 AS apc_list_usd
  FROM based)"""

EDGES_SQL = """
edges AS (
  SELECT DISTINCT 'W' || b AS cited_work_id, 'W' || a AS citing_work_id, CAST(y AS INTEGER) AS citing_publication_year
  FROM (SELECT l_orderkey AS a, l_partkey * 7 % (SELECT max(o_orderkey) FROM orders) + 1 AS b, year(o_orderdate) AS y
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE a <> b)"""

TEXT_SQL = f"""
WITH works AS (
  SELECT 'D' || doc_id AS id, string_split(text, chr(10))[1] AS title, text AS abstract, [lang, source] AS keywords,
    CAST(doc_id % 10 + 2015 AS INTEGER) AS publication_year, [{_list(COUNTRIES)}[doc_id % 25 + 1]] AS all_country_codes,
    'Journal ' || source AS source_name, ['Medicine', 'Chemistry', 'Nursing', 'Mathematics'][doc_id % 4 + 1] AS field_name,
    ['Pulmonology', 'Surgery', 'Oncology'][doc_id % 3 + 1] AS subfield_name, 'lung and bird research' AS topic
  FROM documents)"""
