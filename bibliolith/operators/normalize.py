"""Uploaded tables under their many headings become works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings that uploads use for a column, the best first.
ID_HEADINGS = ("id", "Work ID", "Accession Number", "Pubmed ID", "PMID", "pmid", "DOI", "doi")
TEXT_HEADINGS = {
    "doi": ("DOI", "DI", "Digital Object Identifier"),
    "title": ("Article Title", "Title", "TI", "display_name", "document_title"),
    "source_name": ("Source", "Source title", "Journal", "SO", "journal_title"),
    "subfield": ("Research Area", "WoS Categories", "Web of Science Categories", "WC"),
}
AUTHOR_HEADINGS = ("Authors", "Author Full Names", "AU", "AF", "authors")
NUMBER_HEADINGS = {
    "publication_year": ("int", ("Year", "Publication Date", "PY", "PubYear")),
    "cited_by_count": ("long", ("Citation count", "Times Cited", "Citations", "TC")),
    "fwci": ("double", ("FWCI", "Category Normalized Citation Impact", "CNCI", "Journal Normalized Citation Impact")),
    "percentile": ("double", ("Citation percentile by subfield", "Percentile in Subject Area")),
    "is_top_10": ("int", ("Top 10% cited",)),
    "is_top_1": ("int", ("Top 1% cited",)),
    "is_oa": ("int", ("Is oa", "Open Access")),
    "referenced_works_count": ("int", ("Reference count", "Cited Reference Count", "NR")),
    "is_retracted": ("int", ("Retracted",)),
    "is_paratext": ("int", ("Is paratext",)),
    "is_doaj_indexed": ("int", ("DOAJ",)),
    "is_core_journal": ("int", ("CWTS core",)),
    "has_repository_fulltext": ("int", ("Has repository fulltext",)),
    "apc_paid_usd": ("double", ("Estimated APC paid",)),
    "apc_list_usd": ("double", ("APC sum",)),
}


def _found(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in columns), None)


def _raw(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def split_authors(text: Column) -> Column:
    """Semicolons part names; commas do if the text has no digit; else it is one name."""
    text = F.trim(F.coalesce(text, F.lit("")))
    by = lambda mark: F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.contains(text, F.lit(";")), by(";"))
        .when(F.contains(text, F.lit(",")) & ~F.rlike(text, F.lit("[0-9]")), by(","))
        .otherwise(F.array(text))
    )


def year_of(text: Column) -> Column:
    """The first four digits, else 0."""
    return F.coalesce(F.regexp_extract(text.cast("string"), r"(\d{4})", 1).try_cast("int"), F.lit(0))


def scale_percentile(works: DataFrame) -> DataFrame:
    """Shares of one become percent, if no value of the whole table is above 1: decided by one aggregate."""
    top = works.agg(F.max("percentile")).first()[0]
    return works.withColumn("percentile", F.col("percentile") * 100.0) if top is not None and 0 < top <= 1 else works


# The standard columns of works, by kind, in the order of their kind.
STANDARD_COLUMNS = {
    "string": (
        "id doi title abstract oa_status source_id source_name source_type country_code subfield field domain topic topic_id "
        "subfield_id field_id domain_id license"
    ),
    "array<string>": (
        "author_names author_ids institution_names institution_ids institution_rors institution_types all_country_codes sdg_ids "
        "sdgs concept_ids concepts keywords funder_names funder_ids awards counts_by_year referenced_works"
    ),
    "int": "publication_year is_top_10 is_top_1 is_oa is_retracted is_paratext is_doaj_indexed is_core_journal has_repository_fulltext referenced_works_count",
    "long": "cited_by_count",
    "double": "fwci percentile apc_paid_usd apc_list_usd",
}


def fill_columns(table: DataFrame) -> DataFrame:
    """All standard columns: a missing list is empty, a missing name, id or title is empty text, and others are null."""
    missing = {}
    for kind, names in STANDARD_COLUMNS.items():
        for name in names.split():
            if name not in table.columns:
                empty = F.array() if kind.startswith("array") else F.lit("" if kind == "string" and any(x in name for x in ("name", "id", "title", "doi")) else None)
                missing[name] = empty.cast(kind)
    return table.withColumns(missing) if missing else table


def normalize(table: DataFrame) -> DataFrame:
    """Adds or repairs the standard columns; the others stay."""
    columns = table.columns
    key = _found(columns, ID_HEADINGS)
    if key is None:
        made = F.concat(F.lit("custom_work_"), F.monotonically_increasing_id().cast("string"))
    else:
        made = F.trim(F.regexp_replace(F.coalesce(_raw(key).cast("string"), F.lit("")), "^(https://openalex.org/|MEDLINE:)", ""))
    out = table.withColumn("id", made)
    for name, headings in TEXT_HEADINGS.items():
        other = _found(columns, headings)
        if name not in columns and other:
            out = out.withColumn(name, F.trim(F.coalesce(_raw(other).cast("string"), F.lit(""))))
    if "field" not in columns and "subfield" in out.columns:
        out = out.withColumn("field", F.col("subfield"))
    authors = _found(columns, AUTHOR_HEADINGS)
    if "author_names" not in columns and authors:
        out = out.withColumn("author_names", split_authors(_raw(authors).cast("string")))
    for name, (kind, headings) in NUMBER_HEADINGS.items():
        held = name if name in columns else _found(columns, headings)
        zero = F.lit(0).cast(kind)
        if held is None:
            out = out.withColumn(name, zero)
        elif name == "publication_year":
            out = out.withColumn(name, year_of(_raw(held)))
        else:
            number = _raw(held).cast("string").try_cast("double").cast(kind)
            out = out.withColumn(name, F.coalesce(number, zero))
    return scale_percentile(fill_columns(out))
