"""The thirty indicators of a set of works.

All but the h-index are ratios of additive accumulators, so a corpus, an entity table, a period
table and a yearly cube share one definition.  The h-index follows from the histogram of citation
counts, which is aggregated first and on the way carries the accumulators: works are shuffled once,
in partial sums by (keys, citation count), and a group of any size is a short histogram by the time
it is put in order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even, percent, ratio

# Countries of the Global South.
GLOBAL_SOUTH = (
    "MX BR AR CL CO PE UY VE EC BO PY CU DO CR PA GT HN SV NI JM TT "
    "ZA EG NG KE GH ET TZ UG DZ MA TN SN CM CI ZW "
    "IN ID PK BD PH VN TH MY IR IQ JO LB LK NP KZ UZ"
).split()
OPEN_ROUTES = ("gold", "diamond", "green", "hybrid", "bronze")
DIAMOND_SAVING_USD = 1800.0


def _status(name: str) -> Column:
    return F.lower("oa_status") == name


def _south_only() -> Column:
    named = F.filter("all_country_codes", lambda c: c != "")
    return (F.size("all_country_codes") > 1) & F.forall(named, lambda c: c.isin(*GLOBAL_SOUTH))


def _counted() -> dict[str, Column]:
    return {
        "cited_docs": F.col("cited_by_count") > 0,
        "top10_docs": (F.col("is_top_10") == 1) | (F.col("percentile") >= 90.0),
        "top1_docs": (F.col("is_top_1") == 1) | (F.col("percentile") >= 99.0),
        "oa_docs": (F.col("is_oa") == 1) | F.lower("oa_status").isin(*OPEN_ROUTES),
        **{f"{s}_docs": _status(s) for s in ("gold", "hybrid", "diamond", "green", "bronze", "closed")},
        "doaj_docs": F.col("is_doaj_indexed") == 1,
        "core_docs": F.col("is_core_journal") == 1,
        "international_docs": F.size("all_country_codes") > 1,
        "domestic_docs": F.size("all_country_codes") <= 1,
        "industry_docs": F.array_contains("institution_types", "company"),
        "south_docs": _south_only(),
        "retracted_docs": F.col("is_retracted") == 1,
        "paratext_docs": F.col("is_paratext") == 1,
        "i10_docs": F.col("cited_by_count") >= 10,
    }


def accumulators() -> dict[str, Column]:
    """Additive measures of a group of works; sums of them over disjoint groups are those of the union."""
    return {
        "doc_count": F.count(F.lit(1)),
        "cites_sum": F.sum(F.col("cited_by_count").cast("long")),
        "fwci_sum": F.sum(F.coalesce("fwci", F.lit(0.0))),
        "percentile_sum": F.sum(F.coalesce("percentile", F.lit(0.0))),
        "apc_sum": F.sum(F.coalesce("apc_paid_usd", F.lit(0.0))),
        **{name: F.count_if(F.coalesce(flag, F.lit(False))) for name, flag in _counted().items()},
    }


def indicators() -> dict[str, Column]:
    """Name to expression over accumulators and ``h_index``, in report order."""
    n = F.col("doc_count")

    def share(name: str, digits: int) -> Column:
        return percent(F.col(name), n, digits)

    return {
        "num_documents": n,
        "times_cited": F.col("cites_sum"),
        "cites_per_doc": ratio(F.col("cites_sum"), n, 2),
        "pct_docs_cited": share("cited_docs", 2),
        "fwci_avg": ratio(F.col("fwci_sum"), n, 2),
        "avg_percentile": ratio(F.col("percentile_sum"), n, 1),
        "docs_top_10": F.col("top10_docs"),
        "pct_top_10": share("top10_docs", 2),
        "docs_top_1": F.col("top1_docs"),
        "pct_top_1": share("top1_docs", 3),
        "h_index": F.col("h_index"),
        "i10_index": F.col("i10_docs"),
        "pct_oa_total": share("oa_docs", 1),
        "pct_oa_gold": share("gold_docs", 1),
        "pct_oa_hybrid": share("hybrid_docs", 1),
        "pct_oa_diamond": share("diamond_docs", 1),
        "pct_oa_green": share("green_docs", 1),
        "pct_oa_bronze": share("bronze_docs", 1),
        "pct_oa_closed": share("closed_docs", 1),
        "pct_doaj": share("doaj_docs", 1),
        "pct_cwts_core": share("core_docs", 1),
        "pct_international": share("international_docs", 1),
        "pct_domestic": share("domestic_docs", 1),
        "pct_industry": share("industry_docs", 1),
        "pct_global_south": share("south_docs", 1),
        "estimated_apc_paid_usd": half_even(F.col("apc_sum"), 2),
        "avg_apc_per_doc_usd": ratio(F.col("apc_sum"), n, 2),
        "estimated_diamond_savings_usd": F.col("diamond_docs") * DIAMOND_SAVING_USD,
        "pct_retracted": share("retracted_docs", 2),
        "pct_paratext": share("paratext_docs", 2),
    }


# Report headings, in order.
DISPLAY = {
    "name": "Name",
    "rank": "Rank",
    "publication_year": "Publication Year",
    "num_documents": "Documents",
    "times_cited": "Times Cited",
    "cites_per_doc": "Citation Impact",
    "pct_docs_cited": "% Docs Cited",
    "fwci_avg": "Field-Weighted Citation Impact (FWCI)",
    "avg_percentile": "Average Percentile",
    "docs_top_10": "Documents in Top 10%",
    "pct_top_10": "% Documents in Top 10%",
    "docs_top_1": "Documents in Top 1%",
    "pct_top_1": "% Documents in Top 1%",
    "h_index": "H-Index",
    "i10_index": "i10-Index",
    "pct_oa_total": "% All Open Access Documents",
    "pct_oa_gold": "% Gold Documents",
    "pct_oa_hybrid": "% Gold - Hybrid Documents",
    "pct_oa_diamond": "% Free to Read / Diamond Documents",
    "pct_oa_green": "% Green Repository Documents",
    "pct_oa_bronze": "% Bronze Documents",
    "pct_oa_closed": "% Non-Open Access Documents",
    "pct_doaj": "% DOAJ Indexed Documents",
    "pct_cwts_core": "% CWTS Core Documents",
    "pct_international": "% International Collaborations",
    "pct_domestic": "% Domestic Collaborations",
    "pct_industry": "% Industry Collaborations",
    "pct_global_south": "% Global South Collaborations",
    "estimated_apc_paid_usd": "Estimated APC Paid (USD)",
    "avg_apc_per_doc_usd": "Average APC per Document (USD)",
    "estimated_diamond_savings_usd": "Estimated Diamond Savings (USD)",
    "pct_retracted": "% Retracted Papers",
    "pct_paratext": "% Paratext Documents",
    "country": "Country",
}

METRIC_NAMES = (
    "num_documents times_cited cites_per_doc pct_docs_cited fwci_avg avg_percentile docs_top_10 pct_top_10 docs_top_1 "
    "pct_top_1 h_index i10_index pct_oa_total pct_oa_gold pct_oa_hybrid pct_oa_diamond pct_oa_green pct_oa_bronze "
    "pct_oa_closed pct_doaj pct_cwts_core pct_international pct_domestic pct_industry pct_global_south "
    "estimated_apc_paid_usd avg_apc_per_doc_usd estimated_diamond_savings_usd pct_retracted pct_paratext"
).split()


def accumulate(works: DataFrame, keys: list[str]) -> DataFrame:
    """Accumulators and ``h_index`` of each group; without keys, one row if there is any work."""
    sums = accumulators()
    by_count = works.groupBy(*keys, "cited_by_count").agg(*[c.alias(n) for n, c in sums.items()])
    descending = Window.partitionBy(*keys).orderBy(F.col("cited_by_count").desc())
    reached = F.sum("doc_count").over(descending.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = by_count.withColumn("_h", F.least("cited_by_count", reached))
    return placed.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums], F.max("_h").cast("long").alias("h_index"))


def narrow(works: DataFrame, *kept: Column | str) -> DataFrame:
    """Works as few numbers: what they count for is a bit each of ``flags``."""
    bits = [F.when(F.coalesce(flag, F.lit(False)), 1 << k).otherwise(0) for k, flag in enumerate(_counted().values())]
    numbers = [F.coalesce(n, F.lit(0.0)).alias(n) for n in ("fwci", "percentile", "apc_paid_usd")]
    return works.select(*kept, F.col("cited_by_count").cast("long").alias("cited_by_count"), *numbers, functools.reduce(Column.bitwiseOR, bits).alias("flags"))


def narrow_accumulators(sign: Column | None = None) -> dict[str, Column]:
    """The accumulators of ``narrow`` works; with a sign, of what they add and take away."""
    one = F.lit(1) if sign is None else sign
    held = lambda k: F.col("flags").bitwiseAND(1 << k) != 0
    return {
        "doc_count": F.count(one) if sign is None else F.sum(one),
        "cites_sum": F.sum(F.col("cited_by_count") * one),
        "fwci_sum": F.sum(F.col("fwci") * one),
        "percentile_sum": F.sum(F.col("percentile") * one),
        "apc_sum": F.sum(F.col("apc_paid_usd") * one),
        **{n: F.count_if(held(k)) if sign is None else F.sum(F.when(held(k), one).otherwise(0)) for k, n in enumerate(_counted())},
    }


def accumulate_narrow(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """As ``accumulate``, of ``narrow`` works with nearly as many groups: they move once, and are summed up where they meet."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("cited_by_count").desc()))
    placed = rows.repartition(partitions, *keys).withColumn("_h", F.least("cited_by_count", place.cast("long")))
    return placed.groupBy(*keys).agg(*[c.alias(n) for n, c in narrow_accumulators().items()], F.max("_h").alias("h_index"))


def indicator_table(works: DataFrame, keys: list[str]) -> DataFrame:
    return from_accumulators(accumulate(works, keys), keys)


def from_accumulators(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.select(*keys, *[c.alias(n) for n, c in indicators().items()])


def display(table: DataFrame) -> DataFrame:
    """Report headings and order; the country comes last."""
    return table.select(*[F.col(c).alias(h) for c, h in DISPLAY.items() if c in table.columns])
