"""Queries of filters, searches, joins, aggregations, tables and row-level operators."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_id, doi_key
from ..functions.numeric import half_even
from ..operators import citations, containment, corpora, cubes, documents, enrich, normalize, pairs, reports, resolve, search, tables
from ..operators.entities import ENTITIES, sdg_name
from ..operators.filters import filter_works, has_other_entities
from ..operators.indicators import indicator_table
from ..operators.periods import assign_all, assign_first, consecutive_windows, sliding_windows
from ..session import delete_with_the_driver, shared_folder
from ..sources import files
from ..sources.nested_works import NESTED_WORK, flatten_works
from ..sources.pubmed import AFFILIATION_NAMES, records
from ..streaming.cubes import maintain_corrected, read_corrected
from . import reference_sql as sql
from .catalog import PERIODS, SLIDING, register
from .testworks import COUNTRIES, EDGES_SQL, TEXT_SQL, WORKS_SQL, adjacency, cube, edges, entity_index, stored, stored_at, table, text_index, text_works, works

W, T = WORKS_SQL, TEXT_SQL
PICKED = ("id", "publication_year", "cited_by_count")
IDS = [f"W{k}" for k in range(0, 4000, 7)] + ["https://openalex.org/W9", "W9"]
ID_LIST = ", ".join(f"'W{k}'" for k in range(0, 4000, 7))


def _picked(rows):
    return rows.select(*PICKED)


# --- scans ---------------------------------------------------------------------------------------

register("scan_works", lambda s, d: _picked(works(s, d).where("publication_year = 1998")), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE publication_year = 1998")
register("scan_parquet", lambda s, d: table(s, d, "nation").select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")
register("scan_from_ids", lambda s, d: _picked(corpora.by_ids(works(s, d), IDS)), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE id IN ({ID_LIST}, 'W9')")
register(
    "scan_from_dois",
    lambda s, d: _picked(corpora.by_dois(works(s, d), [f"https://doi.org/10.1000/W{k}" for k in range(0, 900, 3)])),
    f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE CAST(substr(id, 2) AS BIGINT) < 900 AND CAST(substr(id, 2) AS BIGINT) % 3 = 0",
)
register("corpus_load_dispatch", lambda s, d: _picked(corpora.Corpus.load(works(s, d), ["10.1000/w5", "10.1000/w8"]).works), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE id IN ('W5', 'W8')")

_FILTERS = {
    "scan_from_source": ({"source_id": "S5"}, "source_id = 'S5' AND publication_year BETWEEN 1970 AND 2026"),
    "scan_from_institution": ({"institution_id": "I7", "start_year": 1996, "end_year": 1999}, "(list_contains(institution_ids, 'I7') OR list_contains(institution_rors, 'I7')) AND publication_year BETWEEN 1996 AND 1999"),
    "scan_from_topic": ({"topic_id": "T3"}, "(topic_id = 'T3' OR list_contains(all_topics, 'T3'))"),
    "filter_year": ({"start_year": 1996, "end_year": 1997}, "publication_year BETWEEN 1996 AND 1997"),
    "filter_title_query": ({"query": "Ring"}, "contains(lower(title), 'ring')"),
    "filter_domain": ({"domains": "ASIA,EUROPE"}, "domain_name IN ('ASIA', 'EUROPE')"),
    "filter_field": ({"field": "NATION_3"}, "field_name = 'NATION_3'"),
    "filter_subfield": ({"subfields": ["ECONOMY", "PROMO"]}, "subfield_name IN ('ECONOMY', 'PROMO')"),
    "filter_topic_or": ({"topic_ids": ["T1", "https://openalex.org/T2"]}, "(topic_id IN ('T1', 'T2') OR list_has_any(all_topics, ['T1', 'T2']))"),
    "filter_topic_and": ({"topic_ids": ["T1", "T2"], "topic_logic": "and"}, "(topic_id = 'T1' OR list_contains(all_topics, 'T1')) AND (topic_id = 'T2' OR list_contains(all_topics, 'T2'))"),
    "filter_source": ({"source_ids": "S1, https://openalex.org/S2"}, "source_id IN ('S1', 'S2')"),
    "filter_institution_or": ({"institution_ids": ["I1", "ror2"]}, "list_has_any(institution_ids, ['I1']) OR list_has_any(institution_rors, ['ror2'])"),
    "filter_institution_and": ({"institution_ids": ["I1", "I2"], "institution_logic": "AND"}, "list_contains(institution_ids, 'I1') AND list_contains(institution_ids, 'I2')"),
    "filter_author_or": ({"author_ids": ["A1", "A2"]}, "list_has_any(author_ids, ['A1', 'A2'])"),
    "filter_author_and": ({"author_ids": ["A1", "A2"], "author_logic": "AND"}, "list_has_all(author_ids, ['A1', 'A2'])"),
    "filter_country_or": ({"country_codes": ["mx", "br"]}, "list_has_any(country_codes, ['MX', 'BR'])"),
    "filter_country_and": ({"country_codes": ["MX", "US"], "country_logic": "AND"}, "list_has_all(country_codes, ['MX', 'US'])"),
    "filter_work_type": ({"work_types": ["Article", "all"]}, "type = 'article'"),
    "filter_oa": ({"is_oa": "true"}, "is_oa = 1"),
    "filter_oa_status": ({"oa_status": "Gold"}, "oa_status = 'gold'"),
    "filter_doaj": ({"is_doaj": True}, "(is_doaj_indexed = 1 OR journal_is_in_doaj = 1)"),
    "filter_core": ({"is_core": True}, "(is_core_journal = 1 OR journal_is_core = 1)"),
    "filter_combined": ({"country_codes": "MX", "oa_status": "diamond", "start_year": 1996, "end_year": 2000}, "list_contains(country_codes, 'MX') AND oa_status = 'diamond' AND publication_year BETWEEN 1996 AND 2000"),
}
for _name, (_dict, _where) in _FILTERS.items():
    register(_name, lambda s, d, f=_dict: _picked(filter_works(works(s, d), f)), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE {_where}")

register(
    "filter_wos",
    lambda s, d: _picked(filter_works(works(s, d), {"country_codes": "MX"}, search.topic("ring"))),
    f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE list_contains(country_codes, 'MX') AND (title LIKE '%ring%' OR abstract LIKE '%ring%' OR list_contains(keywords, 'ring'))",
)
register("filter_year_positive", lambda s, d: works(s, d).where("publication_year > 0").groupBy("publication_year").count().withColumnRenamed("count", "n"), f"{W} SELECT publication_year, count(*) AS n FROM works WHERE publication_year > 0 GROUP BY 1")
register("filter_entity_nonempty", lambda s, d: works(s, d).select(F.explode("keywords").alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT name, count(*) AS n FROM (SELECT unnest(keywords) AS name FROM works) WHERE name <> '' GROUP BY 1")
register("filter_having_min_docs", lambda s, d: reports.full_table(works(s, d), ENTITIES["publication_sources"], min_docs=12).select("name", "num_documents", "rank"), f"SELECT name, num_documents, rank FROM ({sql.full('publication_sources', min_docs=12)})")
register("filter_table_text", lambda s, d: tables.search_text(reports.full_table(works(s, d), ENTITIES["organizations"]).select("name", "num_documents"), "0000[1-3]$"), f"SELECT name, num_documents FROM ({sql.full('organizations')}) WHERE regexp_matches(name, '0000[1-3]$')")
register("filter_citing_text", lambda s, d: _picked(citations.matching(works(s, d), "brand#2")), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE contains(lower(title), 'brand#2') OR contains(lower(field_name), 'brand#2') OR len(list_filter(author_names, lambda x: contains(lower(x), 'brand#2'))) > 0")
for _slug, _needle, _where in (
    ("locations", "mx", "len(list_filter(country_codes, lambda x: contains(lower(x), 'mx'))) > 0"),
    ("organizations", "00002", "len(list_filter(institution_names, lambda x: contains(lower(x), '00002'))) > 0"),
    ("research_areas_field", "nation_1", "contains(lower(field_name), 'nation_1')"),
):
    register(f"filter_entity_match_{_slug}", lambda s, d, e=_slug, n=_needle: _picked(citations.of_entity(works(s, d), e, n)), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE {_where}")

# --- searches ------------------------------------------------------------------------------------

_TOKEN = r"'(?i)(^|[^0-9a-z\x{{80}}-\x{{10FFFF}}]){0}([^0-9a-z\x{{80}}-\x{{10FFFF}}]|$)'"
_tok = lambda c, w: f"regexp_matches({c}, {_TOKEN.format(w)})"
_word = lambda w: f"({_tok('title', w)} OR {_tok('abstract', w)} OR len(list_filter(keywords, lambda x: {_tok('x', w)})) > 0)"
_like = lambda p: f"(title ILIKE '{p}' OR abstract ILIKE '{p}' OR len(list_filter(keywords, lambda x: x ILIKE '{p}')) > 0)"
_near = r"(?i)\b(?:with\b(?:\s+\S+){0,5}\s+\bthe|the\b(?:\s+\S+){0,5}\s+\bwith)\b"
_SEARCHES = {
    "wos_term": (lambda: search.topic("with"), _word("with")),
    "wos_phrase": (lambda: search.phrase("of the"), _like("%of the%")),
    "wos_wildcard": (lambda: search.wildcard("ther*on"), _like("%ther%on%")),
    "wos_wildcard_short": (lambda: search.wildcard("th?n", ("title",)), r"regexp_matches(title, '(?i)\bth.n')"),
    "wos_near": (lambda: search.near("with", "the", 5), f"(regexp_matches(title, '{_near}') OR regexp_matches(abstract, '{_near}'))"),
    "wos_field_ti": (lambda: search.title("the"), _tok("title", "the")),
    "wos_field_ab": (lambda: search.abstract("from"), _tok("abstract", "from")),
    "wos_field_ts": (lambda: search.topic("src3"), _word("src3")),
    "wos_field_cu": (lambda: search.country("Mexico"), "list_contains(all_country_codes, 'MX')"),
    "wos_field_wc": (lambda: search.category("Respiratory System"), "(subfield_name IN ('Pulmonology', 'Respiratory Medicine') OR (field_name = 'Medicine' AND contains(topic, 'lung')))"),
    "wos_field_wc_fallback": (lambda: search.category("Math"), "contains(lower(field_name), 'math')"),
    "wos_field_py": (lambda: search.years("2016-2018"), "publication_year BETWEEN 2016 AND 2018"),
    "wos_field_so": (lambda: search.source("journal SRC1"), "contains(lower(source_name), 'journal src1')"),
    "wos_field_au_su_og_ad": (lambda: search.author("with"), f"({_tok('title', 'with')} OR {_tok('abstract', 'with')})"),
    "wos_not": (lambda: search.country("Mexico") & ~search.topic("with"), f"list_contains(all_country_codes, 'MX') AND NOT {_word('with')}"),
    "wos_bool": (lambda: search.conjunction(search.years("2019"), search.topic("with") | search.country("Brazil")), f"publication_year = 2019 AND ({_word('with')} OR list_contains(all_country_codes, 'BR'))"),
}
for _name, (_condition, _where) in _SEARCHES.items():
    register(_name, lambda s, d, c=_condition: text_works(s, d).where(c()).select("id", "publication_year"), f"{T} SELECT id, publication_year FROM works WHERE {_where}")

# The same searches, answered by the stored index.
for _name, _indexed, _where in (
    ("wos_index_term", lambda i: i.term("with"), _word("with")),
    ("wos_index_phrase", lambda i: i.phrase("of the"), _like("%of the%")),
    ("wos_index_wildcard", lambda i: i.wildcard("ther*on"), _like("%ther%on%")),
    ("wos_index_wildcard_leading", lambda i: i.term("*ingly", ("abstract",)), "contains(lower(abstract), 'ingly')"),
    ("wos_index_wildcard_short", lambda i: i.wildcard("th?n", ("title",)), r"regexp_matches(title, '(?i)\bth.n')"),
    ("wos_index_near", lambda i: i.near("with", "the", 5), f"(regexp_matches(title, '{_near}') OR regexp_matches(abstract, '{_near}'))"),
    ("wos_index_field_ti", lambda i: i.term("the", ("title",)), _tok("title", "the")),
    ("wos_index_keyword", lambda i: i.term("src3"), _word("src3")),
):
    register(_name, lambda s, d, f=_indexed: f(text_index(s, d)), f"{T} SELECT id FROM works WHERE {_where}")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spread(s, d):
    """Documents whose countries, subfields, fields and topics go through all that the search tables know."""
    n = F.col("doc_id")
    pick = lambda values, step: F.element_at(F.array(*map(F.lit, values)), (n * step % len(values)).cast("int") + 1)
    return table(s, d, "documents").select(
        F.array(pick(_CODES, 1), pick(_CODES, 7)).alias("all_country_codes"), pick(_SUBFIELDS, 1).alias("subfield_name"),
        pick(_FIELDS, 3).alias("field_name"), pick(_TOPICS, 5).alias("topic"),
    )


_CODES = sorted(set(search.COUNTRY_CODES.values()))
_SUBFIELDS = sorted({x for c in search.CATEGORIES.values() for x in c.subfields})
_FIELDS = sorted({x for c in search.CATEGORIES.values() for x in (c.field, c.within) if x} | {"Small veterinary"})
_TOPICS = sorted({f"On {w.upper()} matters" for c in search.CATEGORIES.values() for w in c.topics} | {"Other"})
_listed = lambda values: "[" + ", ".join(map(_quoted, values)) + "]"
_SPREAD_SQL = f"""spread AS (SELECT [{_listed(_CODES)}[doc_id % {len(_CODES)} + 1], {_listed(_CODES)}[doc_id * 7 % {len(_CODES)} + 1]] AS all_country_codes,
  {_listed(_SUBFIELDS)}[doc_id % {len(_SUBFIELDS)} + 1] AS subfield_name, {_listed(_FIELDS)}[doc_id * 3 % {len(_FIELDS)} + 1] AS field_name,
  {_listed(_TOPICS)}[doc_id * 5 % {len(_TOPICS)} + 1] AS topic FROM documents)"""


def _counts(s, d, test, names):
    """How many rows each name finds, in one pass."""
    counts = _spread(s, d).agg(*[F.count_if(test(x)).alias(f"c{k}") for k, x in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"c{k}").alias("n")) for k, x in enumerate(names)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def _category_sql(c) -> str:
    parts = [f"subfield_name IN ({', '.join(map(_quoted, c.subfields))})"] if c.subfields else []
    parts += [f"field_name = {_quoted(c.field)}"] if c.field else []
    parts += [f"field_name ILIKE '%{c.field_part}%'"] if c.field_part else []
    about = "(" + " OR ".join(f"topic ILIKE '%{w}%'" for w in c.topics) + ")"
    parts += [f"(field_name = {_quoted(c.within)} AND {about})" if c.within else about] if c.topics else []
    return " OR ".join(parts)


register(
    "wos_field_cu_all",
    lambda s, d: _counts(s, d, search.country, list(search.COUNTRY_CODES)),
    f"WITH {_SPREAD_SQL}, names(name, code) AS (VALUES " + ", ".join(f"({_quoted(n)}, '{c}')" for n, c in search.COUNTRY_CODES.items()) + ") "
    "SELECT name, (SELECT count(*) FROM spread WHERE list_contains(all_country_codes, code)) AS n FROM names",
)
register(
    "wos_field_wc_all",
    lambda s, d: _counts(s, d, search.category, list(search.CATEGORIES)),
    f"WITH {_SPREAD_SQL} " + " UNION ALL ".join(f"SELECT {_quoted(n)} AS name, count(*) AS n FROM spread WHERE {_category_sql(c)}" for n, c in search.CATEGORIES.items()),
)
register("wos_count", lambda s, d: corpora.summary(text_works(s, d).where(search.topic("with"))), f"{T} SELECT count(*) AS total, min(publication_year) AS min_year, max(publication_year) AS max_year FROM works WHERE {_word('with')}")
register("wos_preview", lambda s, d: _picked(corpora.most_cited(works(s, d).where(search.topic("ring")), 25, 50)), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE title LIKE '%ring%' ORDER BY cited_by_count DESC, id LIMIT 25 OFFSET 50")
register("wos_fetch", lambda s, d: _picked(works(s, d).where(search.topic("ring")).orderBy(F.col("cited_by_count").desc(), "id")), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE title LIKE '%ring%'")

_apart = r"(?i)\b(?:with\b(?:\s+\S+){0,3}\s+\b(?:of\s+the|ther\w*)|(?:of\s+the|ther\w*)\b(?:\s+\S+){0,3}\s+\bwith)\b"
register(
    "wos_near_pattern",
    lambda s, d: _ascii(text_works(s, d)).where(search.near("with", ["of the", "ther*"], 3)).select("id"),
    f"{T} SELECT id FROM (SELECT id, regexp_replace(title, '[^\\x00-\\x7f]', ' ', 'g') AS title, regexp_replace(abstract, '[^\\x00-\\x7f]', ' ', 'g') AS abstract FROM works) WHERE regexp_matches(title, '{_apart}') OR regexp_matches(abstract, '{_apart}')",
)


def _ascii(rows):
    """What counts as a letter beyond ASCII differs between regular expression libraries."""
    return rows.withColumns({c: F.regexp_replace(c, r"[^\x00-\x7f]", " ") for c in ("title", "abstract")})


_NARROWING = [{"country_codes": ["MX"]}, {"start_year": 1}, {"topic_ids": []}, {"institution_ids": ["I1"], "search": "x"}, {"search": "x"}, {"work_types": ["article"]}, {}]
register(
    "filter_has_other_entities",
    lambda s, d: s.createDataFrame([(k, has_other_entities(f)) for k, f in enumerate(_NARROWING)], "k int, narrowed boolean"),
    "SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, true), (4, false), (5, true), (6, false)) t(k, narrowed)",
)


def _uploaded(s, d, suffix, write):
    """Nations as a file that a user might send, read back by its suffix."""
    rows = table(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("Accession Number"), F.concat(F.col("n_name"), F.lit(', "x"; y')).alias("Article Title"), (F.col("n_regionkey") + 2000).cast("string").alias("Year"))
    if "folder" not in _FILES:
        _FILES["folder"] = f"{shared_folder(s)}/bibliolith-files-{uuid.uuid4().hex}"
        delete_with_the_driver(s, _FILES["folder"])
    path = f"{_FILES['folder']}/{abs(hash(d))}.{suffix}"
    write(rows.coalesce(1).write.mode("overwrite"), path)
    return files.load(s, path).select("id", "title", "publication_year")


_FILES: dict[str, str] = {}
_UPLOADED_SQL = "SELECT 'N' || n_nationkey AS id, n_name || ', \"x\"; y' AS title, CAST(n_regionkey + 2000 AS INTEGER) AS publication_year FROM nation"
register("scan_csv", lambda s, d: _uploaded(s, d, "csv", lambda w, p: w.option("header", True).option("escape", '"').csv(p)), _UPLOADED_SQL)
register("scan_jsonl", lambda s, d: _uploaded(s, d, "jsonl", lambda w, p: w.json(p)), _UPLOADED_SQL)

# --- joins ---------------------------------------------------------------------------------------

register("join_semi_corpus", lambda s, d: _picked(corpora.by_ids(works(s, d), table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("https://openalex.org/W"), "o_orderkey").alias("i")))), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE CAST(substr(id, 2) AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
register("join_array_unnest", lambda s, d: works(s, d).select("id", F.explode(F.array_distinct("institution_names")).alias("name")), f"{W} SELECT id, unnest(institution_names) AS name FROM works")
register(
    "join_source_names_by_name",
    lambda s, d: enrich.with_source_names(
        table(s, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("S"), "c_custkey")).alias("name")),
        table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("S"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("display_name"), F.concat(F.lit("C"), "c_nationkey").alias("country_code")),
    ),
    "SELECT CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name ELSE 'S' || c_custkey END AS name, CASE WHEN c_custkey % 3 = 2 AND c_custkey % 5 = 0 THEN 'S' || c_custkey WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS display_name, "
    "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'C' || c_nationkey END AS country FROM customer",
)
register(
    "join_source_names",
    lambda s, d: enrich.with_source_names(
        works(s, d).groupBy(F.col("source_id").alias("name")).agg(F.count(F.lit(1)).alias("n")),
        table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("S"), "c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.concat(F.lit("C"), "c_nationkey").alias("country_code")),
    ),
    f"{W} SELECT w.name, n, coalesce(c_name, w.name) AS display_name, coalesce('C' || c_nationkey, '') AS country FROM (SELECT source_id AS name, count(*) AS n FROM works GROUP BY 1) w LEFT JOIN customer ON 'S' || c_custkey = w.name AND c_custkey % 5 <> 0",
)


def _supplier_dim(s, d):
    code = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("s_nationkey").cast("int") + 1)
    region = F.concat(F.lit("Region "), F.col("s_nationkey") % 3)
    raw = F.to_json(F.struct(code.alias("country_code"), F.struct(region.alias("region")).alias("geo")))
    return table(s, d, "supplier").select(F.lower("s_name").alias("display_name"), code.alias("country_code"), raw.alias("raw_data"))


_ISO = "[" + ", ".join(f"'{c}'" for c in COUNTRIES) + "]"
register(
    "join_institution_country",
    lambda s, d: enrich.with_country(works(s, d).select(F.explode("institution_names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")), _supplier_dim(s, d), "display_name", F.col("country_code")),
    f"{W} SELECT w.name, n, {_ISO}[s_nationkey + 1] AS country FROM (SELECT name, count(*) AS n FROM (SELECT unnest(institution_names) AS name FROM works) GROUP BY 1) w JOIN supplier ON s_name = w.name",
)
register(
    "join_funder_country",
    lambda s, d: enrich.with_country(table(s, d, "supplier").select(F.col("s_name").alias("name")), _supplier_dim(s, d), "display_name", enrich.raw_country()),
    f"SELECT s_name AS name, {_ISO}[s_nationkey + 1] AS country FROM supplier",
)
register(
    "join_subnational_country",
    lambda s, d: _supplier_dim(s, d).groupBy(enrich.raw_region().alias("region")).agg(F.min(enrich.raw_country()).alias("country")),
    f"SELECT 'Region ' || (s_nationkey % 3) AS region, min({_ISO}[s_nationkey + 1]) AS country FROM supplier GROUP BY 1",
)


def _authors(s, d):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("C"), "c_nationkey").alias("country_code"))).alias("last_known_institutions")))).otherwise("{}")
    last = F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return table(s, d, "customer").select(F.col("c_name").alias("display_name"), raw.alias("raw_data"), last.alias("last_known_institution_name"))


register(
    "join_author_country",
    lambda s, d: enrich.author_country(_authors(s, d), table(s, d, "supplier").select(F.col("s_name").alias("display_name"), F.concat(F.lit("N"), "s_nationkey").alias("country_code"))),
    "SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_nationkey ELSE 'N' || s_nationkey END AS country FROM customer LEFT JOIN supplier ON s_name = 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')",
)
register(
    "join_source_name_backfill",
    lambda s, d: enrich.backfill_source_names(works(s, d).withColumn("source_name", F.lit("")), table(s, d, "customer").select(F.concat(F.lit("S"), "c_custkey").alias("id"), F.col("c_name").alias("display_name"))).select("id", "source_name"),
    f"{W} SELECT id, source_name FROM works",
)
_CORPUS_SQL = "corpus AS (SELECT * FROM works WHERE oa_status = 'gold' AND publication_year < 1998)"


def _corpus(s, d):
    return works(s, d).where("oa_status = 'gold' and publication_year < 1998")


register("join_citing", lambda s, d: _picked(citations.citing_works(_corpus(s, d), edges(s, d), works(s, d))), f"{W}, {EDGES_SQL}, {_CORPUS_SQL} SELECT id, publication_year, cited_by_count FROM works WHERE id IN (SELECT citing_work_id FROM edges WHERE cited_work_id IN (SELECT id FROM corpus))")
register("join_references", lambda s, d: _picked(citations.referenced_works(_corpus(s, d), edges(s, d), works(s, d))), f"{W}, {EDGES_SQL}, {_CORPUS_SQL} SELECT id, publication_year, cited_by_count FROM works WHERE id IN (SELECT cited_work_id FROM edges WHERE citing_work_id IN (SELECT id FROM corpus))")
register("derive_citing_corpus", lambda s, d: indicator_table(citations.citing_works(_corpus(s, d), edges(s, d), works(s, d)), ["publication_year"]).select("publication_year", "num_documents", "h_index"), f"{W}, {EDGES_SQL}, {_CORPUS_SQL}, derived AS (SELECT *, row_number() OVER (PARTITION BY publication_year ORDER BY cited_by_count DESC) AS place FROM works WHERE id IN (SELECT citing_work_id FROM edges WHERE cited_work_id IN (SELECT id FROM corpus))) SELECT publication_year, count(*) AS num_documents, count(*) FILTER (WHERE cited_by_count >= place) AS h_index FROM derived GROUP BY 1")
register("derive_referenced_corpus", lambda s, d: corpora.summary(citations.referenced_works(_corpus(s, d), edges(s, d), works(s, d))), f"{W}, {EDGES_SQL}, {_CORPUS_SQL} SELECT count(*) AS total, min(publication_year) AS min_year, max(publication_year) AS max_year FROM works WHERE id IN (SELECT cited_work_id FROM edges WHERE citing_work_id IN (SELECT id FROM corpus))")


def _external(s, d):
    return table(s, d, "orders").where("o_orderkey % 6 = 0").select(F.concat(F.lit("https://doi.org/10.1000/W"), "o_orderkey").alias("doi"))


register("join_doi_enrich", lambda s, d: _picked(resolve.enrich_by_doi(_external(s, d), works(s, d))), f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE CAST(substr(id, 2) AS BIGINT) % 6 = 0")
register(
    "join_pubmed_left",
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("pmid"), "c_name").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("pmid"), "s_name"), "pmid", "left"),
    "SELECT c_custkey AS pmid, c_name, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)
register("join_matrix_periods", lambda s, d: reports.matrix(works(s, d), ENTITIES["sector_types"], SLIDING), sql.matrix("sector_types", SLIDING, reports.MATRIX_METRICS))
register("join_citing_lists", lambda s, d: adjacency(s, d).citing_ids(_corpus(s, d)), f"{W}, {EDGES_SQL}, {_CORPUS_SQL} SELECT DISTINCT citing_work_id AS id FROM edges WHERE cited_work_id IN (SELECT id FROM corpus)")
register("join_references_lists", lambda s, d: adjacency(s, d).referenced_ids(_corpus(s, d)), f"{W}, {EDGES_SQL}, {_CORPUS_SQL} SELECT DISTINCT cited_work_id AS id FROM edges WHERE citing_work_id IN (SELECT id FROM corpus)")
_MOST = "SELECT cited_work_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"


def _citing_of_the_most_cited(spark, sf_dir):
    lists = adjacency(spark, sf_dir)
    most = lists.lists["cited"].groupBy("work").agg(F.sum(F.size("neighbours")).alias("n")).orderBy(F.desc("n"), "work").limit(1)
    return lists.neighbours(most.select(F.col("work").alias("id")), "cited").select("id", "year")


register("join_citing_of_one", _citing_of_the_most_cited, f"WITH {EDGES_SQL} SELECT citing_work_id AS id, citing_publication_year AS year FROM edges WHERE cited_work_id = ({_MOST})")
register("join_institution_pairs_blocks", lambda s, d: pairs.institution_pairs(works(s, d), ["id"], block=2).select("id", F.concat_ws(pairs.BETWEEN, "a", "b").alias("pair")), f"{W} SELECT id, {sql.KEYS_SQL['organizations_colab']} AS pair FROM works")
register("agg_colab_pairs_blocks", lambda s, d: pairs.pair_table(works(s, d), min_docs=2), sql.full("organizations_colab", min_docs=2))
register("join_institution_pairs", lambda s, d: works(s, d).select("id", F.explode(ENTITIES["organizations_colab"].key()).alias("pair")), f"{W} SELECT id, {sql.KEYS_SQL['organizations_colab']} AS pair FROM works")
register(
    "join_identifier_cascade",
    lambda s, d: resolve.resolve(
        table(s, d, "part").select(
            F.col("p_partkey").alias("key"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("P"), "p_partkey")).alias("pmid"),
            F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://doi.org/10.1/X"), "p_partkey")).alias("doi"),
            F.concat_ws(" ", "p_name", "p_type").alias("title"),
        ).where("key % 3 <> 2"),
        table(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("pmid"), F.concat(F.lit("10.1/x"), "p_partkey").alias("doi"), F.lit("unlike anything").alias("title")),
    ),
    "SELECT p_partkey AS key, 'P' || p_partkey AS pmid, CASE p_partkey % 3 WHEN 0 THEN 'pmid' ELSE 'doi' END AS stage FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 2 = 0",
)
register(
    "join_identifier_cascade_titles",
    lambda s, d: resolve.resolve(
        table(s, d, "part").select(
            F.col("p_partkey").alias("key"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("P"), "p_partkey")).alias("pmid"),
            F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://doi.org/10.1/X"), "p_partkey")).alias("doi"),
            F.concat_ws(" ", "p_name", "p_type").alias("title"),
        ),
        table(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("pmid"), F.concat(F.lit("10.1/x"), "p_partkey").alias("doi"), F.concat_ws(" ", F.lit("The"), "p_name", "p_type").alias("title")),
    ),
)
register("resolve_title_similarity", lambda s, d: resolve.similar_documents(text_works(s, d).select("id", "title")))

# --- aggregations --------------------------------------------------------------------------------

_BASE = sql.measured(["name"], "keyed")
register("agg_corpus_baseline", lambda s, d: reports.baseline(works(s, d)), f"{sql.keyed('corpus')} {_BASE}")
register("report_period", lambda s, d: reports.baseline(works(s, d), (1997, 1999)), f"{sql.keyed('corpus', 'publication_year BETWEEN 1997 AND 1999')} {_BASE}")
register("report_recent", lambda s, d: reports.period_table(works(s, d), ENTITIES["locations"], (1999, 2001)), sql.full("locations", "publication_year BETWEEN 1999 AND 2001"))
register("agg_entity_table", lambda s, d: reports.full_table(works(s, d), ENTITIES["researchers"], limit=10), sql.full("researchers", limit=10))
register("agg_entity_trend", lambda s, d: reports.trend_table(works(s, d), ENTITIES["funding_agencies"]), sql.trend("funding_agencies"))
_DIFFERENCES = ", ".join(f"{sql.change(m, f'lag({m}) OVER (ORDER BY publication_year)')} AS {n}" for m, n in (("num_documents", "docs_growth"), ("times_cited", "cites_growth")))
register("agg_corpus_trend", lambda s, d: reports.corpus_trend(works(s, d)), f"{sql.keyed('corpus', 'publication_year > 0')}, yearly AS ({sql.measured(['name', 'publication_year'], 'keyed')}) SELECT *, {_DIFFERENCES} FROM yearly")
register("report_trend_growth", lambda s, d: reports.corpus_trend(works(s, d)).select("publication_year", "docs_growth", "cites_growth"), f"{sql.keyed('corpus', 'publication_year > 0')}, yearly AS ({sql.measured(['name', 'publication_year'], 'keyed')}) SELECT publication_year, {_DIFFERENCES} FROM yearly")
register("agg_corpus_multi_period", lambda s, d: indicator_table(assign_all(works(s, d), SLIDING), ["period"]), f"{sql.keyed('corpus')}, dated AS ({sql.dated(SLIDING)}) {sql.measured(['period'], 'dated')}")
register("agg_entity_multi_period", lambda s, d: reports.period_tables(works(s, d), ENTITIES["locations"], SLIDING, limit=10), sql.periods_table("locations", SLIDING, limit=10))
register("window_assign_all", lambda s, d: assign_all(works(s, d), SLIDING).groupBy("period").agg(F.count(F.lit(1)).alias("n")), f"{sql.keyed('corpus')}, dated AS ({sql.dated(SLIDING)}) SELECT period, count(*) AS n FROM dated GROUP BY 1")
register("window_assign_first", lambda s, d: assign_first(works(s, d), SLIDING).groupBy("period").agg(F.count(F.lit(1)).alias("n")), f"SELECT period, sum(num_documents)::BIGINT AS n FROM ({sql.periods_table('corpus', SLIDING, first=True)}) GROUP BY 1")
_CONSECUTIVE = f"""{sql.keyed('corpus')}, dated AS ({sql.dated(PERIODS)}), m AS ({sql.measured(['period'], 'dated')})
SELECT *, CASE WHEN lag(num_documents) OVER w = 0 AND num_documents > 0 THEN 100.0 ELSE {sql.change('num_documents', 'lag(num_documents) OVER w')} END AS docs_change,
{sql.change('times_cited', 'lag(times_cited) OVER w')} AS cites_change, {sql.rounded('fwci_avg - lag(fwci_avg) OVER w', 2)} AS fwci_change
FROM m WINDOW w AS (ORDER BY period)"""
register("report_consecutive_table", lambda s, d: reports.consecutive_table(works(s, d), PERIODS), _CONSECUTIVE)
register("report_matrix_colab", lambda s, d: reports.matrix(works(s, d), ENTITIES["organizations_colab"], PERIODS[:2], min_docs=1, limit=200), sql.matrix("organizations_colab", PERIODS[:2], reports.MATRIX_METRICS, limit=200))
register("agg_colab_pairs", lambda s, d: reports.full_table(works(s, d), ENTITIES["organizations_colab"], min_docs=2), sql.full("organizations_colab", min_docs=2))
_NARROW = ("name", "num_documents", "times_cited", "rank")
register(
    "report_matrix_consolidated",
    lambda s, d: reports.consolidated({e: reports.full_table(works(s, d), ENTITIES[e]).select(*_NARROW) for e in ("locations", "keywords")}),
    f"SELECT 'locations' AS entity, {', '.join(_NARROW)} FROM ({sql.full('locations')}) UNION ALL SELECT 'keywords', {', '.join(_NARROW)} FROM ({sql.full('keywords')})",
)
register("report_rank", lambda s, d: reports.full_table(works(s, d), ENTITIES["concepts"]).select("rank", "name", "num_documents"), f"SELECT rank, name, num_documents FROM ({sql.full('concepts')})")
register("agg_country_first", lambda s, d: works(s, d).groupBy("source_id").agg(F.min(F.upper(F.trim("country_code"))).alias("country")), f"{W} SELECT source_id, min(country_code) AS country FROM works GROUP BY 1")
register("agg_min_max_count", lambda s, d: corpora.summary(works(s, d)), f"{W} SELECT count(*) AS total, min(publication_year) AS min_year, max(publication_year) AS max_year FROM works")
register("agg_type_breakdown", lambda s, d: works(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT type, count(*) AS n FROM works GROUP BY 1")
register("agg_year_breakdown", lambda s, d: works(s, d).groupBy("publication_year").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT publication_year, count(*) AS n FROM works GROUP BY 1")
register("agg_count_distinct", lambda s, d: works(s, d).agg(F.countDistinct("source_id").alias("n")), f"{W} SELECT count(DISTINCT source_id) AS n FROM works")
register("agg_max_snapshot", lambda s, d: works(s, d).agg(F.max("publication_date").alias("latest")), f"{W} SELECT max(publication_date) AS latest FROM works")
register(
    "agg_citation_counts",
    lambda s, d: citations.citation_counts(_corpus(s, d), edges(s, d), works(s, d)),
    f"{W}, {EDGES_SQL}, {_CORPUS_SQL} SELECT (SELECT count(*) FROM edges WHERE cited_work_id IN (SELECT id FROM corpus)) AS edges, (SELECT count(DISTINCT citing_work_id) FROM edges WHERE cited_work_id IN (SELECT id FROM corpus)) AS citing_works, (SELECT count(DISTINCT cited_work_id) FROM edges WHERE citing_work_id IN (SELECT id FROM corpus)) AS \"references\", (SELECT round(count(*) FILTER (WHERE r IN (SELECT id FROM works)) * 100.0::DOUBLE / count(*), 4) FROM (SELECT DISTINCT cited_work_id AS r FROM edges WHERE citing_work_id IN (SELECT id FROM corpus))) AS coverage_pct",
)
register("agg_entity_search_counts", lambda s, d: tables.entity_counts(works(s, d), "institution_ids", "institution_names", "0001"), f"{W}, pairs AS (SELECT unnest(institution_ids) AS id, unnest(institution_names) AS display_name FROM works) SELECT id, display_name, count(*) AS works FROM pairs WHERE contains(lower(display_name), '0001') GROUP BY 1, 2 ORDER BY works DESC, id, display_name LIMIT 20")
register("h_index_by_year", lambda s, d: indicator_table(works(s, d), ["publication_year"]).select("publication_year", "h_index", "i10_index"), f"{sql.keyed('corpus')} SELECT publication_year, h_index, i10_index FROM ({sql.measured(['publication_year'], 'keyed')})")

_CUBE_KEYS = {
    "countries": ("unnest(country_codes) AS country", "country"),
    "topics": ("topic_id AS topic", "topic"),
    "institutions": ("unnest(institution_names) AS institution", "institution"),
    "sources": ("source_id AS source", "source"),
    "topic_country": ("topic_id AS topic, unnest(country_codes) AS country", "topic, country"),
}
_COUNTED = {
    "cited_docs": "cited_by_count > 0",
    "top10_docs": "is_top_10 = 1 OR percentile >= 90",
    "top1_docs": "is_top_1 = 1 OR percentile >= 99",
    "oa_docs": "is_oa = 1 OR lower(oa_status) IN ('gold', 'diamond', 'green', 'hybrid', 'bronze')",
    **{f"{r}_docs": f"oa_status = '{r}'" for r in ("gold", "hybrid", "diamond", "green", "bronze", "closed")},
    "doaj_docs": "is_doaj_indexed = 1",
    "core_docs": "is_core_journal = 1",
    "international_docs": "len(all_country_codes) > 1",
    "domestic_docs": "len(all_country_codes) <= 1",
    "industry_docs": "list_contains(institution_types, 'company')",
    "south_docs": f"len(all_country_codes) > 1 AND list_has_all({sql._SOUTH}, list_filter(all_country_codes, lambda x: x <> ''))",
    "retracted_docs": "is_retracted = 1",
    "paratext_docs": "is_paratext = 1",
    "i10_docs": "cited_by_count >= 10",
}
_SUMS = "count(*) AS doc_count, sum(cited_by_count)::BIGINT AS cites_sum, sum(fwci) AS fwci_sum, sum(percentile) AS percentile_sum, sum(apc_paid_usd) AS apc_sum, "
_SUMS += ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _COUNTED.items())
for _cube, (_keys, _names) in _CUBE_KEYS.items():
    register(
        f"agg_cube_build_{_cube}",
        lambda s, d, c=_cube: cubes.build(works(s, d), c),
        f"{W} SELECT {_names}, publication_year, {_SUMS} FROM (SELECT * EXCLUDE (topic), {_keys} FROM works WHERE publication_year > 0) GROUP BY {_names}, publication_year",
    )


def _corrected_cube(spark, sf_dir):
    """The works come twice through a stream, first as they were with other citations; their cube is that of the last state."""

    def stream(path):
        rows = works(spark, sf_dir)
        was = rows.withColumn("cited_by_count", F.col("cited_by_count") * 2 + 1).withColumn("publication_year", F.col("publication_year") - 1)
        for version, state in enumerate((was, rows)):
            state.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/in")
        files = spark.readStream.schema(rows.withColumn("version", F.lit(0)).schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
        maintain_corrected(files, "countries", f"{path}/cube", f"{path}/checkpoint", version="version", fold_every=3).awaitTermination()

    return read_corrected(spark, "countries", stored_at(spark, sf_dir, "corrected", stream) + "/cube").drop("citations")


_countries = _CUBE_KEYS["countries"]
register(
    "stream_cube_corrected",
    _corrected_cube,
    f"{W} SELECT {_countries[1]}, publication_year, {_SUMS} FROM (SELECT * EXCLUDE (topic), {_countries[0]} FROM works WHERE publication_year > 0) GROUP BY {_countries[1]}, publication_year",
)
_ADDITIVE = ", ".join(f"{e} AS {n}" for n, e in sql.METRICS_SQL.items() if n != "h_index")
register("agg_cube_rollup", lambda s, d: cubes.rollup(cube(s, d, "countries"), ["country"], (1996, 1999)), f"{W} SELECT country, {_ADDITIVE} FROM (SELECT *, unnest(country_codes) AS country FROM works WHERE publication_year BETWEEN 1996 AND 1999) GROUP BY country")
register("scan_cube", lambda s, d: cubes.rollup(cube(s, d, "sources"), ["publication_year"]), f"{W} SELECT publication_year, {_ADDITIVE} FROM works GROUP BY 1")
register("agg_subperiod_derivation", lambda s, d: cubes.rollup(cube(s, d, "topics"), ["topic"], (1997, 1998)), f"{W} SELECT topic_id AS topic, {_ADDITIVE} FROM works WHERE publication_year BETWEEN 1997 AND 1998 GROUP BY 1")

_ALL = ", ".join(f"{e} AS {n}" for n, e in sql.METRICS_SQL.items())
for _cube, (_unnest, _names) in _CUBE_KEYS.items():
    register(
        f"agg_cube_report_{_cube}",
        lambda s, d, c=_cube: cubes.report(cube(s, d, c), list(cubes.CUBES[c]), (1996, 1999)),
        f"{W} SELECT {_names}, {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY {_names} ORDER BY cited_by_count DESC) AS place "
        f"FROM (SELECT * EXCLUDE (topic), {_unnest} FROM works WHERE publication_year BETWEEN 1996 AND 1999)) GROUP BY {_names}",
    )

_KEPT = {"wide": {"start_year": 1994, "end_year": 1999, "country_codes": ["MX", "BR", "US"]}, "narrow": {"start_year": 1997, "end_year": 1997}}


def _from_kept_corpus(spark, sf_dir):
    """A corpus that lies inside a kept one is read from there."""
    wanted = {"start_year": 1997, "end_year": 1998, "country_codes": ["MX", "BR"], "country_logic": "AND"}
    name = containment.answer({n: (f, 0) for n, f in _KEPT.items()}, wanted)
    kept = stored(spark, sf_dir, f"corpus_{name}", lambda path: filter_works(works(spark, sf_dir), _KEPT[name]).write.parquet(path))
    return _picked(containment.from_stored(kept, wanted))


_both = " AND ".join(f"(coalesce(country_code, '') = '{c}' OR list_contains(country_codes, '{c}') OR list_contains(all_country_codes, '{c}'))" for c in ("MX", "BR"))
register("corpus_coverage_check", _from_kept_corpus, f"{W} SELECT id, publication_year, cited_by_count FROM works WHERE publication_year BETWEEN 1997 AND 1998 AND {_both}")
register(
    "corpus_coverage_cube",
    lambda s, d: containment.from_sources_cube(cube(s, d, "sources"), {"start_year": 1994, "source_ids": "S1,S2,S4,S5,S7"}),
    f"{W} SELECT {_ALL} FROM (SELECT *, row_number() OVER (ORDER BY cited_by_count DESC) AS place FROM works WHERE publication_year BETWEEN 1994 AND 2026 AND source_id IN ('S1', 'S2', 'S4', 'S5', 'S7')) HAVING count(*) > 0",
)

# --- tables, sets, rows --------------------------------------------------------------------------

register("topk_cited", lambda s, d: _picked(corpora.most_cited(works(s, d), 40)), f"{W} SELECT id, publication_year, cited_by_count FROM works ORDER BY cited_by_count DESC, id LIMIT 40")
register("page_offset", lambda s, d: _picked(corpora.page(works(s, d), 25, 75).rows), f"{W} SELECT id, publication_year, cited_by_count FROM works ORDER BY cited_by_count DESC, id LIMIT 25 OFFSET 75")
register("limit_by", lambda s, d: _picked(tables.limit_by(works(s, d), ["publication_year"], [F.col("cited_by_count").desc(), F.col("id")], 5)), f"{W} SELECT id, publication_year, cited_by_count FROM works QUALIFY row_number() OVER (PARTITION BY publication_year ORDER BY cited_by_count DESC, id) <= 5")
register("limit_corpus", lambda s, d: corpora.summary(corpora.bounded(works(s, d), 100)), f"{W} SELECT count(*) AS total, min(publication_year) AS min_year, max(publication_year) AS max_year FROM (SELECT * FROM works ORDER BY id LIMIT 100)")
register("sort_dynamic", lambda s, d: tables.sort_by(works(s, d).select("id", "title"), "title", descending=True, tie="id").limit(30), f"{W} SELECT id, title FROM works ORDER BY lower(title) DESC, id LIMIT 30")
register("table_preview", lambda s, d: tables.preview(reports.full_table(works(s, d), ENTITIES["organizations"]).select("name", "num_documents", "cites_per_doc"), "supplier", "num_documents", True, 20, 10, "name"), f"SELECT name, num_documents, cites_per_doc FROM ({sql.full('organizations')}) ORDER BY num_documents DESC, name LIMIT 20 OFFSET 10")
register("set_distinct_ids", lambda s, d: edges(s, d).select(canonical_id(F.col("citing_work_id")).alias("id")).distinct(), f"{W}, {EDGES_SQL} SELECT DISTINCT citing_work_id AS id FROM edges")
register("set_distinct_edges", lambda s, d: edges(s, d).distinct(), f"{W}, {EDGES_SQL} SELECT * FROM edges")
register(
    "set_dedup_keys",
    lambda s, d: tables.dedup_by_first_key(table(s, d, "customer").select(F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("eid"), F.when(F.col("c_custkey") % 4 == 1, F.lit("x")).alias("doi")).select("eid", "doi"), ["eid", "doi"]).groupBy("eid").agg(F.count(F.lit(1)).alias("n")),
    "SELECT eid, CASE WHEN eid IS NULL THEN count(*) ELSE 1 END AS n FROM (SELECT CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS eid FROM customer) GROUP BY 1",
)
register("set_union_chunks", lambda s, d: _picked(works(s, d).where("publication_year < 1998").unionByName(works(s, d).where("publication_year >= 1998"))), f"{W} SELECT id, publication_year, cited_by_count FROM works")
_NAMES = {
    "domains": ("a", "domain_name AS id, domain_name AS display_name FROM works"),
    "types": ("rt", "type AS id, type AS display_name FROM works"),
    "fields": ("nation_1", "field_name AS id, field_name AS display_name FROM works"),
    "countries": ("mex", "unnest(country_codes) AS id, 'Mexico' AS display_name FROM works"),
    "sources": ("0002", "source_id AS id, source_name AS display_name FROM works"),
    "institutions": ("0001", "unnest(institution_ids) AS id, unnest(institution_names) AS display_name FROM works"),
}


def _found_names(spark, sf_dir):
    index = entity_index(spark, sf_dir)
    return functools.reduce(DataFrame.unionByName, [index.search(kind, text, 20) for kind, (text, _) in _NAMES.items()])


register(
    "entity_search_index",
    _found_names,
    f"{W}, named AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{t}' AS part, {e}" for k, (t, e) in _NAMES.items()) + "), "
    "counted AS (SELECT kind, id, display_name, count(*) AS works FROM named WHERE contains(lower(display_name), part) AND (kind <> 'countries' OR id = 'MX') GROUP BY ALL), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY works DESC, display_name, id) AS place FROM counted) "
    "SELECT kind, id, display_name, works FROM ranked WHERE place <= 20",
)
register("entity_search", lambda s, d: tables.entity_search(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("display_name"), F.col("p_size").alias("works_count")), "ring", "works_count"), "SELECT p_partkey AS id, p_name || ' ' || p_type AS display_name, p_size AS works_count FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') ORDER BY p_size DESC, display_name, id LIMIT 20")
register("yearly_citations", lambda s, d: citations.yearly_citations(_corpus(s, d), edges(s, d)), f"{W}, {EDGES_SQL}, {_CORPUS_SQL} SELECT citing_publication_year, count(*) AS citations FROM edges WHERE cited_work_id IN (SELECT id FROM corpus) GROUP BY 1")
register(
    "window_gen_consecutive",
    lambda s, d: s.createDataFrame([(a, b) for a, b in consecutive_windows(1995, 2001, 3)], "first int, last int"),
    "SELECT * FROM (VALUES (1995, 1995), (1996, 1998), (1999, 2001)) t(first, last)",
)
register(
    "window_gen_sliding",
    lambda s, d: s.createDataFrame(sliding_windows(1995, 1998, 2), "first int, last int"),
    "SELECT * FROM (VALUES (1995, 1996), (1996, 1997), (1997, 1998)) t(first, last)",
)

_SDG_SQL = sql._SDG
register("doc_sdg", lambda s, d: works(s, d).select("id", documents.goals(F.col("sdgs")).alias("sdgs")), f"{W} SELECT id, array_to_string(list_transform(sdgs, lambda x: 'ODS ' || string_split(x, '/')[-1]), '; ') AS sdgs FROM works")
register("scalar_sdg_name", lambda s, d: works(s, d).select("id", sdg_name(F.col("sdgs")[0]).alias("sdg")), f"{W} SELECT id, {_SDG_SQL}[CAST(string_split(sdgs[1], '/')[-1] AS INTEGER)] AS sdg FROM works")
register(
    "doc_collab_type",
    lambda s, d: works(s, d).select("id", documents.collaboration(F.col("all_country_codes"), F.col("institution_names"), F.col("author_names")).alias("kind")),
    f"{W} SELECT id, CASE WHEN len(all_country_codes) > 1 THEN 'Internacional' WHEN len(institution_names) > 1 THEN 'Nacional' WHEN len(author_names) = 1 THEN 'Autor Único' ELSE 'Institucional' END AS kind FROM works",
)
register("doc_percentile", lambda s, d: works(s, d).select("id", documents.percentile(F.col("percentile")).alias("p")), f"{W} SELECT id, {sql.rounded('CASE WHEN percentile > 0 AND percentile <= 1 THEN percentile * 100 ELSE percentile END', 2)} AS p FROM works")
register("doc_top1", lambda s, d: works(s, d).select("id", documents.in_top_1(F.lit(None).cast("int"), F.col("percentile")).alias("top")), f"{W} SELECT id, CASE WHEN percentile >= 99 OR (percentile <= 1 AND percentile >= 0.99) THEN 'Sí' ELSE 'No' END AS top FROM works")
register("doc_flag", lambda s, d: works(s, d).select("id", documents.flag(F.col("is_top_10")).alias("flag")), f"{W} SELECT id, CASE is_top_10 WHEN 1 THEN 'Sí' ELSE 'No' END AS flag FROM works")
register("doc_pages", lambda s, d: works(s, d).select("id", documents.pages(F.col("type"), F.col("oa_status")).alias("pages")), f"{W} SELECT id, type || '-' || oa_status AS pages FROM works")
register("doc_usd", lambda s, d: works(s, d).select("id", documents.usd(F.col("apc_paid_usd")).alias("usd")), f"{W} SELECT id, apc_paid_usd AS usd FROM works")
register("doc_type_label", lambda s, d: works(s, d).select("id", documents.labelled(F.col("type"), documents.TYPE_LABELS, "Article").alias("label")), f"{W} SELECT id, CASE type WHEN 'article' THEN 'Article' WHEN 'review' THEN 'Review' WHEN 'book-chapter' THEN 'Book Chapter' ELSE 'Letter' END AS label FROM works")
register("doc_oa_label", lambda s, d: works(s, d).select("id", documents.labelled(F.col("oa_status"), documents.ROUTE_LABELS, "Cerrada").alias("label")), f"{W} SELECT id, CASE oa_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in documents.ROUTE_LABELS.items()) + " END AS label FROM works")
register("doc_list_to_string", lambda s, d: works(s, d).select("id", documents.joined(F.col("institution_names")).alias("names"), documents.joined_text(F.to_json("keywords")).alias("words")), f"{W} SELECT id, array_to_string(institution_names, '; ') AS names, array_to_string(keywords, '; ') AS words FROM works")
register(
    "doc_table",
    lambda s, d: documents.document_table(works(s, d)),
    f"""{W} SELECT id AS "OpenAlex ID", doi AS "DOI", '' AS "PubMed ID", title AS "Título del Artículo", array_to_string(author_names, '; ') AS "Autores",
source_name AS "Revista / Fuente", source_id AS "ISSN / Fuente ID", domain_name AS "Dominio Temático", field_name AS "Campo",
subfield_name AS "Subcampo (Área de Investigación)", topic AS "Tópico Principal",
CASE type WHEN 'article' THEN 'Article' WHEN 'review' THEN 'Review' WHEN 'book-chapter' THEN 'Book Chapter' ELSE 'Letter' END AS "Tipo de Documento",
'' AS "Volumen", '' AS "Número / Fascículo", '' AS "Páginas", publication_date AS "Fecha de Publicación", publication_year AS "Año",
cited_by_count AS "Citas Totales (OpenAlex)", {sql.rounded('fwci', 3)} AS "FWCI",
{sql.rounded('CASE WHEN percentile > 0 AND percentile <= 1 THEN percentile * 100 ELSE percentile END', 2)} AS "Percentil en su Área",
CASE is_top_10 WHEN 1 THEN 'Sí' ELSE 'No' END AS "Top 10% Más Citado", CASE is_top_1 WHEN 1 THEN 'Sí' ELSE 'No' END AS "Top 1% Más Citado",
CASE WHEN len(all_country_codes) > 1 THEN 'Internacional' WHEN len(institution_names) > 1 THEN 'Nacional' WHEN len(author_names) = 1 THEN 'Autor Único' ELSE 'Institucional' END AS "Tipo de Colaboración",
array_to_string(all_country_codes, ', ') AS "Países Colaboradores",
CASE oa_status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in documents.ROUTE_LABELS.items())} END AS "Vía de Acceso Abierto",
CASE is_oa WHEN 1 THEN 'Sí' ELSE 'No' END AS "Es Acceso Abierto",
array_to_string(list_transform(sdgs, lambda x: 'ODS ' || string_split(x, '/')[-1]), '; ') AS "ODS / Agenda 2030 (SDGs)",
apc_paid_usd AS "Costo APC Estimado (USD)", apc_list_usd AS "Precio de Lista APC (USD)" FROM works""",
)


def _upload(s, d):
    customers = table(s, d, "customer")
    name = F.col("c_name")
    authors = F.when(F.col("c_custkey") % 3 == 0, F.concat(name, F.lit("; B, C"))).when(F.col("c_custkey") % 3 == 1, F.lit("Perez, Lopez")).otherwise(F.concat(name, F.lit(", J")))
    return customers.select(
        F.concat(F.lit("https://openalex.org/W"), "c_custkey").alias("Work ID"),
        name.alias("Article Title"),
        authors.alias("Authors"),
        F.concat(F.lit("Nov "), F.col("c_custkey") % 30 + 1990).alias("Year"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_custkey").cast("string")).alias("Times Cited"),
        (F.col("c_custkey") % 100 / 128.0).alias("Percentile in Subject Area"),
        F.col("c_mktsegment").alias("Research Area"),
    )


register(
    "norm_id",
    lambda s, d: normalize.normalize(_upload(s, d)).select("id", "title", "subfield", "field"),
    "SELECT 'W' || c_custkey AS id, c_name AS title, c_mktsegment AS subfield, c_mktsegment AS field FROM customer",
)
register("norm_aliases", lambda s, d: normalize.normalize(_upload(s, d)).select("title", "publication_year", "is_oa"), "SELECT c_name AS title, CAST(c_custkey % 30 + 1990 AS INTEGER) AS publication_year, 0 AS is_oa FROM customer")
register(
    "norm_authors_split",
    lambda s, d: normalize.normalize(_upload(s, d)).select("id", F.array_join("author_names", "|").alias("authors")),
    "SELECT 'W' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_name || '|B, C' WHEN 1 THEN 'Perez|Lopez' ELSE c_name || ', J' END AS authors FROM customer",
)
register("norm_numeric", lambda s, d: normalize.normalize(_upload(s, d)).select("id", "cited_by_count"), "SELECT 'W' || c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey END AS cited_by_count FROM customer")
register("norm_percentile_scale", lambda s, d: normalize.normalize(_upload(s, d)).select("id", half_even(F.col("percentile"), 3).alias("percentile")), f"SELECT 'W' || c_custkey AS id, {sql.rounded('(c_custkey % 100)::DOUBLE / 128 * 100', 3)} AS percentile FROM customer")
register("scalar_doi_key", lambda s, d: works(s, d).select("id", doi_key(F.concat(F.lit("HTTPS://doi.org/"), F.upper("doi"))).alias("key")), f"{W} SELECT id, lower(doi) AS key FROM works")
register("scalar_json", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")


def _nested(s, d):
    """Nested records made of flat works, as JSON text read with the nested schema."""
    named = lambda i, n: F.struct(i.alias("id"), n.alias("display_name"))
    url = lambda c: F.concat(F.lit("https://openalex.org/"), c)
    makers = F.transform(F.arrays_zip("author_ids", "author_names"), lambda z: F.struct(named(url(z["author_ids"]), F.concat(F.lit(" "), z["author_names"])).alias("author"), F.array(F.lit("MX"), F.lit("")).alias("countries")))
    record = F.to_json(
        F.struct(
            url(F.col("id")).alias("id"),
            F.col("title").alias("display_name"),
            "publication_year",
            "cited_by_count",
            makers.alias("authorships"),
            F.struct(named(url(F.col("source_id")), F.col("source_name")).alias("source")).alias("primary_location"),
            F.struct((F.col("is_oa") == 1).alias("is_oa"), "oa_status").alias("open_access"),
        )
    )
    return works(s, d).select(F.from_json(record, NESTED_WORK).alias("r")).select("r.*")


register(
    "flatten_work",
    lambda s, d: flatten_works(_nested(s, d)).select("id", "title", "publication_year", "source_id", "is_oa", F.array_join("author_names", "|").alias("authors"), F.array_join("author_ids", "|").alias("author_ids"), F.array_join("country_codes", "|").alias("countries")),
    f"{W} SELECT id, title, publication_year, source_id, is_oa, array_to_string(author_names, '|') AS authors, array_to_string(author_ids, '|') AS author_ids, 'MX' AS countries FROM works",
)


def _articles(s, d):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[<>&\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", " ")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), "doc_id", F.lit("</PMID><Article><ArticleTitle>A <i>"), F.substring_index(text, "\n", 1),
        F.lit("</i></ArticleTitle><Abstract><AbstractText>"), text,
        F.lit("</AbstractText></Abstract><Journal><JournalIssue><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Ruiz</LastName><ForeName>A</ForeName><AffiliationInfo><Affiliation>Hospital General, Ciudad de Mexico, Mexico.</Affiliation></AffiliationInfo></Author></AuthorList></Article></MedlineCitation>"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.lit("</PubmedArticle>")),
    )
    return table(s, d, "documents").select(xml.alias("xml"))


register(
    "scan_pubmed_xml",
    lambda s, d: records(_articles(s, d)).select("pmid", "publication_year", F.array_join("author_names", "|").alias("authors"), F.array_join("all_country_codes", "|").alias("countries"), F.array_join("institution_names", "|").alias("institutions")),
    "SELECT CAST(doc_id AS VARCHAR) AS pmid, 2019 AS publication_year, 'Ruiz, A' AS authors, 'MX' AS countries, 'Hospital General' AS institutions FROM documents WHERE doc_id % 10 <> 0",
)


def _affiliated(s, d):
    """An article a name: the name stands last, in the middle, or inside another word, where it doesn't count."""
    names = F.array(*map(F.lit, sorted(AFFILIATION_NAMES)))
    rows = s.range(len(AFFILIATION_NAMES)).select(F.element_at(names, F.col("id").cast("int") + 1).alias("name"), "id")
    at = F.concat(F.lit("<Affiliation>Hospital, City, "), F.initcap("name"), F.lit(".</Affiliation>"))
    inside = F.concat(F.lit("<Affiliation>Hospital, City, X"), "name", F.lit("x, Y</Affiliation>"))
    before = F.concat(F.lit("<Affiliation>Hospital, City "), "name", F.lit(", 1234, a</Affiliation>"))
    author = lambda x: F.concat(F.lit("<AuthorList><Author><LastName>R</LastName><AffiliationInfo>"), x, F.lit("</AffiliationInfo></Author></AuthorList>"))
    xml = lambda kind, x: F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.lit(kind), "name", F.lit("</PMID><Article>"), author(x), F.lit("</Article></MedlineCitation></PubmedArticle>"))
    return rows.select(F.explode(F.array(xml("last ", at), xml("inside ", inside), xml("before ", before))).alias("xml"))


register(
    "pubmed_country",
    lambda s, d: records(_affiliated(s, d)).select("pmid", F.array_join("all_country_codes", "|").alias("countries")),
    "WITH names(name, code) AS (VALUES " + ", ".join(f"({_quoted(n)}, '{c}')" for n, c in AFFILIATION_NAMES.items()) + ") "
    "SELECT 'last ' || name AS pmid, code AS countries FROM names UNION ALL SELECT 'before ' || name, code FROM names UNION ALL SELECT 'inside ' || name, '' FROM names",
)
register("scan_pubmed_texts", lambda s, d: records(_articles(s, d)).select("pmid", "title", "abstract"))
