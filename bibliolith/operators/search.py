"""Bibliographic search as column expressions.

A search is written in Python and combined with ``&``, ``|`` and ``~``::

    topic("lung*") & country("Mexico") & ~title("asthma")
    near("alveol*", ["lung*", "pulmonary"], 5)

Every predicate is a native condition, null-safe, and cheap ones come first where they are
combined by ``conjunction``; Catalyst keeps that order inside a filter.
"""

from __future__ import annotations

import functools
import operator
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TOPIC = ("title", "abstract", "keywords")
LISTS = {"keywords", "author_names", "institution_names"}

# Country names as bibliographic databases write them.
COUNTRY_CODES = {
    "AFGHANISTAN": "AF", "ALBANIA": "AL", "ALGERIA": "DZ", "ARGENTINA": "AR", "AUSTRALIA": "AU", "AUSTRIA": "AT",
    "BANGLADESH": "BD", "BELGIUM": "BE", "BOLIVIA": "BO", "BRAZIL": "BR", "BRASIL": "BR", "CAMEROON": "CM", "CANADA": "CA",
    "CHILE": "CL", "CHINA": "CN", "COLOMBIA": "CO", "COSTA RICA": "CR", "CROATIA": "HR", "CUBA": "CU", "CZECH REPUBLIC": "CZ",
    "CZECHIA": "CZ", "DENMARK": "DK", "DOMINICAN REPUBLIC": "DO", "ECUADOR": "EC", "EGYPT": "EG", "EL SALVADOR": "SV",
    "ENGLAND": "GB", "ESTONIA": "EE", "ETHIOPIA": "ET", "FINLAND": "FI", "FRANCE": "FR", "GERMANY": "DE", "GHANA": "GH",
    "GREECE": "GR", "GUATEMALA": "GT", "HONDURAS": "HN", "HONG KONG": "HK", "HUNGARY": "HU", "ICELAND": "IS", "INDIA": "IN",
    "INDONESIA": "ID", "IRAN": "IR", "IRAQ": "IQ", "IRELAND": "IE", "ISRAEL": "IL", "ITALY": "IT", "JAMAICA": "JM",
    "JAPAN": "JP", "JORDAN": "JO", "KAZAKHSTAN": "KZ", "KENYA": "KE", "KOREA": "KR", "SOUTH KOREA": "KR", "NORTH KOREA": "KP",
    "KUWAIT": "KW", "LATVIA": "LV", "LEBANON": "LB", "LITHUANIA": "LT", "LUXEMBOURG": "LU", "MALAYSIA": "MY", "MEXICO": "MX",
    "MEX": "MX", "MOROCCO": "MA", "NEPAL": "NP", "NETHERLANDS": "NL", "NEW ZEALAND": "NZ", "NICARAGUA": "NI", "NIGERIA": "NG",
    "NORWAY": "NO", "OMAN": "OM", "PAKISTAN": "PK", "PANAMA": "PA", "PARAGUAY": "PY", "PEOPLES R CHINA": "CN", "PERU": "PE",
    "PHILIPPINES": "PH", "POLAND": "PL", "PORTUGAL": "PT", "QATAR": "QA", "ROMANIA": "RO", "RUSSIA": "RU", "SAUDI ARABIA": "SA",
    "SCOTLAND": "GB", "SINGAPORE": "SG", "SLOVAKIA": "SK", "SLOVENIA": "SI", "SOUTH AFRICA": "ZA", "SPAIN": "ES", "ESPANA": "ES",
    "SRI LANKA": "LK", "SWEDEN": "SE", "SWITZERLAND": "CH", "TAIWAN": "TW", "TANZANIA": "TZ", "THAILAND": "TH",
    "TRINIDAD TOBAGO": "TT", "TUNISIA": "TN", "TURKEY": "TR", "TURKIYE": "TR", "UAE": "AE", "UGANDA": "UG", "UKRAINE": "UA",
    "UNITED ARAB EMIRATES": "AE", "UNITED KINGDOM": "GB", "UK": "GB", "UNITED STATES": "US", "USA": "US", "URUGUAY": "UY",
    "UZBEKISTAN": "UZ", "VENEZUELA": "VE", "VIETNAM": "VN", "WALES": "GB",
}


class Category(NamedTuple):
    """A work belongs if it meets any of these; topic words count inside ``within`` only, where a field is named there."""

    subfields: tuple[str, ...] = ()
    field: str = ""
    topics: tuple[str, ...] = ()
    within: str = ""
    field_part: str = ""


# Subject categories in terms of subfields, fields and words of the topic.
CATEGORIES = {
    "RESPIRATORY SYSTEM": Category(("Pulmonology", "Respiratory Medicine"), topics=("respiratory", "pulmonary", "lung"), within="Medicine"),
    "CARDIAC & CARDIOVASCULAR SYSTEMS": Category(("Cardiology and Cardiovascular Medicine",)),
    "CLINICAL NEUROLOGY": Category(("Neurology (clinical)", "Neurology")),
    "ONCOLOGY": Category(("Oncology", "Cancer Research")),
    "SURGERY": Category(("Surgery",)),
    "IMMUNOLOGY": Category(("Immunology", "Immunology and Allergy")),
    "INFECTIOUS DISEASES": Category(("Infectious Diseases",)),
    "PHARMACOLOGY & PHARMACY": Category(("Pharmacology", "Pharmaceutical Science")),
    "NEUROSCIENCES": Category(field="Neuroscience"),
    "BIOCHEMISTRY & MOLECULAR BIOLOGY": Category(("Biochemistry", "Molecular Biology")),
    "GENETICS & HEREDITY": Category(("Genetics", "Genetics (clinical)")),
    "MICROBIOLOGY": Category(("Microbiology", "Microbiology (medical)")),
    "PUBLIC, ENVIRONMENTAL & OCCUPATIONAL HEALTH": Category(("Public Health, Environmental and Occupational Health",)),
    "MEDICINE, GENERAL & INTERNAL": Category(("General Medicine", "Internal Medicine")),
    "PEDIATRICS": Category(("Pediatrics, Perinatology and Child Health",)),
    "ENDOCRINOLOGY & METABOLISM": Category(("Endocrinology, Diabetes and Metabolism",)),
    "GASTROENTEROLOGY & HEPATOLOGY": Category(("Gastroenterology", "Hepatology")),
    "RADIOLOGY, NUCLEAR MEDICINE & MEDICAL IMAGING": Category(("Radiology, Nuclear Medicine and Imaging",)),
    "PATHOLOGY": Category(("Pathology and Forensic Medicine",)),
    "DERMATOLOGY": Category(("Dermatology",)),
    "PSYCHIATRY": Category(("Psychiatry and Mental Health",)),
    "CRITICAL CARE MEDICINE": Category(("Critical Care and Intensive Care Medicine",)),
    "ANESTHESIOLOGY": Category(("Anesthesiology and Pain Medicine",)),
    "NURSING": Category(field="Nursing"),
    "DENTISTRY, ORAL SURGERY & MEDICINE": Category(("Oral Surgery", "General Dentistry")),
    "OPHTHALMOLOGY": Category(("Ophthalmology",)),
    "UROLOGY & NEPHROLOGY": Category(("Urology", "Nephrology")),
    "CHEMISTRY, MULTIDISCIPLINARY": Category(field="Chemistry"),
    "PHYSICS, MULTIDISCIPLINARY": Category(field="Physics and Astronomy"),
    "MATHEMATICS": Category(field="Mathematics"),
    "COMPUTER SCIENCE, ARTIFICIAL INTELLIGENCE": Category(("Artificial Intelligence",)),
    "ENGINEERING, ELECTRICAL & ELECTRONIC": Category(("Electrical and Electronic Engineering",)),
    "MATERIALS SCIENCE, MULTIDISCIPLINARY": Category(field="Materials Science"),
    "ENVIRONMENTAL SCIENCES": Category(("Environmental Science (miscellaneous)", "Environmental Engineering")),
    "VETERINARY SCIENCES": Category(("Small Animals", "Large Animals", "Equine"), field_part="veterinary"),
    "ZOOLOGY": Category(("Animal Science and Zoology", "Ecology, Evolution, Behavior and Systematics")),
    "AGRICULTURE, DAIRY & ANIMAL SCIENCE": Category(("Animal Science and Zoology", "Food Animals")),
    "FISHERIES": Category(("Aquatic Science",)),
    "ORNITHOLOGY": Category(topics=("bird", "ornithol", "avian")),
}


def _any(conditions) -> Column:
    return functools.reduce(operator.or_, conditions)


def conjunction(*conditions: Column) -> Column:
    """AND in the given order: put the cheap and selective conditions first."""
    return functools.reduce(operator.and_, conditions)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _on(columns, test) -> Column:
    """``test`` on any of the columns; a list passes if one of its items does."""
    held = []
    for name in columns:
        if name in LISTS:
            held.append(F.exists(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.coalesce(test(x), F.lit(False))))
        else:
            held.append(test(_text(name)))
    return _any(held)


_TOKEN_EDGE = r"[^0-9a-z\x{80}-\x{10FFFF}]"


def _token(word: str) -> str:
    return f"(?i)(^|{_TOKEN_EDGE}){re.escape(word)}({_TOKEN_EDGE}|$)"


def _wild(word: str, space: str = r"\w*") -> str:
    return "".join({"*": space, "?": "."}.get(c) or re.escape(c) for c in word)


def phrase(text: str, columns=TOPIC) -> Column:
    """A literal run of characters, in any case."""
    return _on(columns, lambda c: F.contains(F.lower(c), F.lower(F.lit(text))))


def wildcard(word: str, columns=TOPIC) -> Column:
    """``*`` for any characters, ``?`` for one.  With a root under three letters, words are anchored."""
    root = re.split(r"[*?]", word, maxsplit=1)[0]
    if len(root) < 3:
        return _on(columns, lambda c: F.rlike(c, F.lit(r"(?i)(?<![0-9A-Za-z_])" + _wild(word, "[0-9A-Za-z_]*"))))
    like = re.sub(r"([%_\\])", r"\\\1", word).replace("*", "%").replace("?", "_")
    return _on(columns, lambda c: F.ilike(c, F.lit(f"%{like}%")))


def term(word: str, columns=TOPIC) -> Column:
    """A whole word, a phrase if it has white space, a pattern if it has wildcards."""
    if re.search(r"\s", word):
        return phrase(word, columns)
    if re.search(r"[*?]", word):
        return wildcard(word, columns)
    return _on(columns, lambda c: F.rlike(c, F.lit(_token(word))))


def topic(word: str) -> Column:
    return term(word, TOPIC)


def title(word: str) -> Column:
    return term(word, ("title",))


def abstract(word: str) -> Column:
    return term(word, ("abstract",))


def _side(words) -> tuple[str, list[str]]:
    options = [words] if isinstance(words, str) else list(words)
    patterns = [r"\s+".join(_wild(w, "[0-9A-Za-z_]*") for w in o.split()) for o in options]
    roots = [max(re.split(r"[*?\s]+", o), key=len).lower() for o in options]
    return "(?:" + "|".join(patterns) + ")", roots


def near(left, right, distance: int, columns=("title", "abstract")) -> Column:
    """Both sides, in either order, with at most ``distance`` words between.  A side may be a list of options.

    A cheap substring test comes before the regular expression, if every option has a root for it.
    """
    (a, a_roots), (b, b_roots) = _side(left), _side(right)
    gap = rf"(?:\s+\S+){{0,{distance}}}\s+"
    edge, stop = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
    both = f"(?i){edge}(?:{a}{stop}{gap}{edge}{b}|{b}{stop}{gap}{edge}{a}){stop}"

    def test(c):
        conditions = []
        for roots in (a_roots, b_roots):
            if all(len(r) >= 3 for r in roots):
                conditions.append(_any([F.contains(F.lower(c), F.lit(r)) for r in roots]))
        return conjunction(*conditions, F.rlike(c, F.lit(both)))

    return _on(columns, test)


def country(name: str) -> Column:
    code = COUNTRY_CODES.get(name.strip().upper(), name.strip().upper()[:2])
    return F.array_contains(F.coalesce("all_country_codes", F.array().cast("array<string>")), code)


def category(name: str) -> Column:
    """A known subject category, or a part of the name of the subfield, field or topic."""
    known = CATEGORIES.get(name.strip().upper())
    if known is None:
        return _any([F.contains(F.lower(_text(c)), F.lit(name.strip().lower())) for c in ("subfield_name", "field_name", "topic")])
    parts = [_text("subfield_name").isin(*known.subfields)] if known.subfields else []
    parts += [_text("field_name") == known.field] if known.field else []
    parts += [F.contains(F.lower(_text("field_name")), F.lit(known.field_part))] if known.field_part else []
    if known.topics:
        about = _any([F.contains(F.lower(_text("topic")), F.lit(w)) for w in known.topics])
        parts.append((_text("field_name") == known.within) & about if known.within else about)
    return _any(parts)


def years(text: str) -> Column:
    """``2020`` or ``2018-2022``; anything else restricts nothing."""
    found = re.fullmatch(r"\s*(\d{4})\s*(?:-\s*(\d{4}))?\s*", text)
    return F.col("publication_year").between(int(found[1]), int(found[2] or found[1])) if found else F.lit(True)


def source(name: str) -> Column:
    return F.contains(F.lower(_text("source_name")), F.lit(name.strip().lower()))


def author(word: str, strict: bool = False) -> Column:
    """Text of title and abstract, or with ``strict`` the authors' names."""
    return term(word, ("author_names",) if strict else ("title", "abstract"))


def organization(word: str, strict: bool = False) -> Column:
    return term(word, ("institution_names",) if strict else ("title", "abstract"))
