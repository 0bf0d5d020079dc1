"""The document table: one readable row a work, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_id, doi_key
from ..functions.numeric import half_even

# Labels of access routes and kinds of document.
ROUTE_LABELS = {
    "diamond": "Diamante (Sin APC)",
    "gold": "Dorada (Con APC)",
    "hybrid": "Híbrida (Con APC)",
    "bronze": "Bronce (Lectura Libre)",
    "green": "Verde (Autoarchivo / Repositorio)",
    "closed": "Cerrada (Bajo Suscripción)",
}
TYPE_LABELS = {
    "article": "Article",
    "review": "Review",
    "book-chapter": "Book Chapter",
    "letter": "Letter",
    "editorial": "Editorial",
    "erratum": "Correction",
    "preprint": "Preprint",
    "book": "Book",
    "dissertation": "Dissertation",
    "dataset": "Dataset",
}
YES, NO = "Sí", "No"


def labelled(column: Column, labels: dict[str, str], missing: str) -> Column:
    key = F.lower(F.trim(column))
    mapping = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return F.when(column.isNull(), missing).otherwise(F.coalesce(F.try_element_at(mapping, key), title_case(column)))


def title_case(column: Column) -> Column:
    """Every run of letters starts with a capital, after a hyphen or a digit too."""
    runs = F.regexp_extract_all(column, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def flag(column: Column) -> Column:
    return F.when(F.lower(F.trim(column.cast("string"))).isin("true", "1", "yes", "si", "sí", "t"), YES).otherwise(NO)


def joined(column: Column, separator: str = "; ") -> Column:
    """A list, or a string that holds a JSON or Python list, as one string."""
    return F.array_join(F.filter(F.transform(column, lambda x: F.trim(x)), lambda x: x != ""), separator)


def joined_text(column: Column, separator: str = "; ") -> Column:
    text = F.trim(F.coalesce(column, F.lit("")))
    items = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    return F.when(text.isin("", "[]", "{}", "None", "nan"), "").when(F.startswith(text, F.lit("[")), F.coalesce(joined(items, separator), text)).otherwise(text)


def pages(first: Column, last: Column) -> Column:
    a, b = F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))
    return F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit("-"), b)).when(a != "", a).otherwise(b)


def percentile(column: Column) -> Column:
    """0 to 100; values up to 1 are shares."""
    value = F.coalesce(column.cast("double"), F.lit(0.0))
    return half_even(F.when((value > 0) & (value <= 1), value * 100).otherwise(value), 2)


def in_top_1(is_top: Column, share: Column) -> Column:
    by_rank = (share >= 99) | ((share <= 1) & (share >= 0.99))
    return F.when(is_top.isNotNull(), flag(is_top)).otherwise(F.when(by_rank, YES).otherwise(NO))


def distinct_names(column: Column, fold) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(column, lambda x: fold(F.trim(x))), lambda x: x != "")))


def collaboration(countries: Column, institutions: Column, authors: Column) -> Column:
    """International, then national, then within an institution, then a single author."""
    empty = F.array().cast("array<string>")
    n_authors = F.size(F.filter(F.coalesce(authors, empty), lambda x: F.trim(x) != ""))
    return (
        F.when(distinct_names(F.coalesce(countries, empty), F.upper) > 1, "Internacional")
        .when(distinct_names(F.coalesce(institutions, empty), F.lower) > 1, "Nacional")
        .when(n_authors == 1, "Autor Único")
        .otherwise("Institucional")
    )


def goals(column: Column) -> Column:
    """Development goals as ``ODS n``."""

    def one(x: Column) -> Column:
        short = F.trim(F.regexp_replace(x, "https://metadata.un.org/sdg/", "ODS "))
        return F.when(F.startswith(short, F.lit("ODS ")), short).otherwise(F.concat(F.lit("ODS "), short))

    return F.array_join(F.transform(F.filter(column, lambda x: F.trim(x) != ""), one), "; ")


def usd(column: Column) -> Column:
    return half_even(F.coalesce(column.cast("double"), F.lit(0.0)), 2)


def document_table(works: DataFrame) -> DataFrame:
    """29 columns under the reports' headings; columns that ``works`` lacks get their defaults."""
    have = set(works.columns)

    def column(*names: str, kind: str = "string") -> Column:
        held = [F.col(n) for n in names if n in have]
        return F.coalesce(*held) if held else F.lit(None).cast(kind)

    def text(*names: str) -> Column:
        return F.trim(F.coalesce(column(*names).cast("string"), F.lit("")))

    names = "array<string>"
    return works.select(
        F.coalesce(canonical_id(column("id")), F.lit("")).alias("OpenAlex ID"),
        F.coalesce(doi_key(column("doi")), F.lit("")).alias("DOI"),
        F.regexp_replace(text("pmid", "pubmed_id"), r"^(https://pubmed\.ncbi\.nlm\.nih\.gov/|PMID:)", "").alias("PubMed ID"),
        text("title").alias("Título del Artículo"),
        F.coalesce(joined(column("author_names", kind=names)), F.lit("")).alias("Autores"),
        text("source_name", "source", "journal").alias("Revista / Fuente"),
        F.coalesce(canonical_id(column("source_id")), F.lit("")).alias("ISSN / Fuente ID"),
        text("domain_name", "domain").alias("Dominio Temático"),
        text("field_name", "field").alias("Campo"),
        text("subfield_name", "subfield").alias("Subcampo (Área de Investigación)"),
        text("topic", "topic_name").alias("Tópico Principal"),
        labelled(column("type"), TYPE_LABELS, "Article").alias("Tipo de Documento"),
        text("volume").alias("Volumen"),
        text("issue").alias("Número / Fascículo"),
        pages(column("first_page"), column("last_page")).alias("Páginas"),
        text("publication_date").alias("Fecha de Publicación"),
        column("publication_year", kind="int").cast("int").alias("Año"),
        F.coalesce(column("cited_by_count", "citations", kind="long").cast("long"), F.lit(0)).alias("Citas Totales (OpenAlex)"),
        half_even(F.coalesce(column("fwci", kind="double"), F.lit(0.0)), 3).alias("FWCI"),
        percentile(column("percentile", kind="double")).alias("Percentil en su Área"),
        flag(column("is_top_10", kind="int")).alias("Top 10% Más Citado"),
        in_top_1(column("is_top_1", kind="int"), column("percentile", kind="double")).alias("Top 1% Más Citado"),
        collaboration(
            column("all_country_codes", "country_codes", kind=names),
            column("institution_names", kind=names),
            column("author_names", kind=names),
        ).alias("Tipo de Colaboración"),
        F.coalesce(joined(column("all_country_codes", "country_codes", kind=names), ", "), F.lit("")).alias("Países Colaboradores"),
        labelled(column("oa_status"), ROUTE_LABELS, "Cerrada").alias("Vía de Acceso Abierto"),
        flag(column("is_oa", kind="int")).alias("Es Acceso Abierto"),
        F.coalesce(goals(column("sdgs", "sdg_ids", kind=names)), F.lit("")).alias("ODS / Agenda 2030 (SDGs)"),
        usd(column("apc_paid_usd", kind="double")).alias("Costo APC Estimado (USD)"),
        usd(column("apc_list_usd", kind="double")).alias("Precio de Lista APC (USD)"),
    )
