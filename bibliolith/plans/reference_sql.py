"""SQL twins of the report queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

from ..operators.entities import SDG_NAMES
from ..operators.indicators import GLOBAL_SOUTH
from .testworks import WORKS_SQL

_ROUTES = "'gold', 'diamond', 'green', 'hybrid', 'bronze'"
_SOUTH = "[" + ", ".join(f"'{c}'" for c in GLOBAL_SOUTH) + "]"


def rounded(expression: str, digits: int) -> str:
    return f"round_even(({expression}) * {10**digits}.0::DOUBLE, 0) / {10**digits}.0::DOUBLE"


def _share(condition: str, digits: int) -> str:
    return rounded(f"count(*) FILTER (WHERE {condition}) * 100.0::DOUBLE / count(*)::DOUBLE", digits)


METRICS_SQL = {
    "num_documents": "count(*)",
    "times_cited": "sum(cited_by_count)::BIGINT",
    "cites_per_doc": rounded("sum(cited_by_count)::DOUBLE / count(*)::DOUBLE", 2),
    "pct_docs_cited": _share("cited_by_count > 0", 2),
    "fwci_avg": rounded("sum(fwci) / count(*)::DOUBLE", 2),
    "avg_percentile": rounded("sum(percentile) / count(*)::DOUBLE", 1),
    "docs_top_10": "count(*) FILTER (WHERE is_top_10 = 1 OR percentile >= 90)",
    "pct_top_10": _share("is_top_10 = 1 OR percentile >= 90", 2),
    "docs_top_1": "count(*) FILTER (WHERE is_top_1 = 1 OR percentile >= 99)",
    "pct_top_1": _share("is_top_1 = 1 OR percentile >= 99", 3),
    "h_index": "count(*) FILTER (WHERE cited_by_count >= place)",
    "i10_index": "count(*) FILTER (WHERE cited_by_count >= 10)",
    "pct_oa_total": _share(f"is_oa = 1 OR lower(oa_status) IN ({_ROUTES})", 1),
    **{f"pct_oa_{s}": _share(f"lower(oa_status) = '{s}'", 1) for s in ("gold", "hybrid", "diamond", "green", "bronze", "closed")},
    "pct_doaj": _share("is_doaj_indexed = 1", 1),
    "pct_cwts_core": _share("is_core_journal = 1", 1),
    "pct_international": _share("len(all_country_codes) > 1", 1),
    "pct_domestic": _share("len(all_country_codes) <= 1", 1),
    "pct_industry": _share("list_contains(institution_types, 'company')", 1),
    "pct_global_south": _share(f"len(all_country_codes) > 1 AND list_has_all({_SOUTH}, list_filter(all_country_codes, lambda x: x <> ''))", 1),
    "estimated_apc_paid_usd": rounded("sum(apc_paid_usd)", 2),
    "avg_apc_per_doc_usd": rounded("sum(apc_paid_usd) / count(*)::DOUBLE", 2),
    "estimated_diamond_savings_usd": "count(*) FILTER (WHERE oa_status = 'diamond') * 1800.0::DOUBLE",
    "pct_retracted": _share("is_retracted = 1", 2),
    "pct_paratext": _share("is_paratext = 1", 2),
}

_SDG = "[" + ", ".join(f"'{n}'" for n in SDG_NAMES) + "]"
KEYS_SQL = {
    "corpus": "'Corpus Completo'",
    "locations": "unnest(list_distinct(country_codes))",
    "locations_subnational": "unnest(list_distinct(country_codes))",
    "organizations": "unnest(list_distinct(institution_names))",
    "organizations_colab": "unnest(list_distinct(flatten(list_transform(institution_names, lambda a: "
    "list_transform(list_filter(institution_names, lambda b: b > a), lambda b: a || ' --- ' || b)))))",
    "sector_types": "unnest(list_distinct(institution_types))",
    "researchers": "unnest(list_distinct(author_names))",
    "publication_sources": "source_id",
    "funding_agencies": "unnest(list_distinct(funder_names))",
    "research_areas_domain": "domain_name",
    "research_areas_field": "field_name",
    "research_areas_subfield": "subfield_name",
    "research_areas_topic": "CASE WHEN topic <> '' THEN topic ELSE topic_id END",
    "research_areas_sdg": f"unnest(list_distinct(list_transform(sdgs, lambda x: {_SDG}[CAST(string_split(x, '/')[-1] AS INTEGER)])))",
    "concepts": "unnest(list_distinct(concepts))",
    "keywords": "unnest(list_distinct(keywords))",
    "economic_apc": "oa_status",
}


def keyed(slug: str, where: str = "true") -> str:
    return f"""{WORKS_SQL},
keyed AS (SELECT * FROM (SELECT *, {KEYS_SQL[slug]} AS name FROM works WHERE {where}) WHERE name <> '')"""


def measured(keys: list[str], source: str) -> str:
    by = ", ".join(keys)
    metrics = ", ".join(f"{e} AS {n}" for n, e in METRICS_SQL.items())
    return f"""SELECT {by}, {metrics}
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cited_by_count DESC) AS place FROM {source}) GROUP BY {by}"""


def full(slug: str, where: str = "true", limit: int = 5000, min_docs: int = 1) -> str:
    return f"""{keyed(slug, where)}, measured AS ({measured(['name'], 'keyed')})
SELECT *, row_number() OVER (ORDER BY num_documents DESC, name) AS rank FROM measured
WHERE num_documents >= {min_docs} QUALIFY rank <= {limit}"""


def dated(periods, full_too: bool = False) -> str:
    parts = [f"SELECT *, '{s}-{e}' AS period FROM keyed WHERE publication_year BETWEEN {s} AND {e}" for s, e in periods]
    if full_too:
        parts.append("SELECT *, 'full' AS period FROM keyed")
    return " UNION ALL ".join(parts)


def periods_table(slug: str, periods, first: bool = False, limit: int = 5000) -> str:
    rows = dated(periods)
    if first:
        cases = " ".join(f"WHEN publication_year BETWEEN {s} AND {e} THEN '{s}-{e}'" for s, e in periods)
        rows = f"SELECT * FROM (SELECT *, CASE {cases} END AS period FROM keyed) WHERE period IS NOT NULL"
    return f"""{keyed(slug)}, dated AS ({rows}), measured AS ({measured(['period', 'name'], 'dated')})
SELECT *, row_number() OVER (PARTITION BY period ORDER BY num_documents DESC, name) AS rank FROM measured QUALIFY rank <= {limit}"""


def trend(slug: str) -> str:
    return f"{keyed(slug, 'publication_year > 0')} {measured(['name', 'publication_year'], 'keyed')}"


def change(now: str, before: str) -> str:
    return rounded(f"({now} - {before})::DOUBLE * 100.0::DOUBLE / nullif({before}, 0)::DOUBLE", 2)


def matrix(slug: str, periods, short_names: dict[str, str], limit: int = 5000) -> str:
    labels = [f"{s}-{e}" for s, e in periods]
    cells = [
        f"coalesce(max({m}) FILTER (WHERE period = '{p}'), 0) AS {short}_{p.replace('-', '_')}" for p in labels for short, m in short_names.items()
    ]
    totals = [f"max({m}) FILTER (WHERE period = 'full') AS {m}" for m in ("num_documents", "times_cited", "cites_per_doc", "h_index")]
    changes = []
    for a, b in zip(labels, labels[1:]):
        x, y = a.replace("-", "_"), b.replace("-", "_")
        for kind in ("docs", "fwci"):
            now, before = f"{kind}_{y}", f"{kind}_{x}"
            changes.append(
                f"CASE WHEN {before} = 0 THEN CASE WHEN {now} > 0 THEN 100.0 ELSE 0.0 END ELSE {change(now, before)} END AS {kind}_change_{y}"
            )
    return f"""{keyed(slug)}, dated AS ({dated(periods, True)}), measured AS ({measured(['name', 'period'], 'dated')}),
wide AS (SELECT name, {', '.join(totals + cells)} FROM measured GROUP BY name)
SELECT *, {', '.join(changes)}, row_number() OVER (ORDER BY num_documents DESC, name) AS rank FROM wide
WHERE num_documents >= 1 QUALIFY rank <= {limit}"""
