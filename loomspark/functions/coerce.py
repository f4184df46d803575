"""Typed casts of scraped text. Whatever cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("true", "yes", "ja", "oui", "1", "y", "j"), ("false", "no", "nein", "non", "0", "n")
#: Date patterns in the order in which they are tried: day before month (fixed order).
_DATES = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.]\d+)?(?:Z|[+-]\d{2}:\d{2})$", ""),
    (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
)


def to_int(text: Column) -> Column:
    s = F.trim(text)
    whole = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))
    return F.coalesce(whole, to_float(s).try_cast("long"))


def to_float(text: Column) -> Column:
    s = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(s.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), s.try_cast("double"))


def to_eur(text: Column) -> Column:
    """An amount in euros as a double: the sign, spaces of all kinds and apostrophes go."""
    return to_float(F.regexp_replace(text, "[€\\u00a0\\u202f\\u2009 ']", ""))


def to_bool(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.isin(*TRUE), F.lit(True)).when(s.isin(*FALSE), F.lit(False))


def to_iso_date(text: Column) -> Column:
    """YYYY-MM-DD as text; a d.m.yyyy inside other text counts too, without a look at the calendar."""
    s = F.trim(text)
    tried = []
    for pattern, layout in _DATES:
        date = F.try_to_date(s, layout) if layout else F.try_to_date(F.left(s, F.lit(10)), "yyyy-MM-dd")
        tried.append(F.date_format(F.when(s.rlike(pattern), date), "yyyy-MM-dd"))
    inside = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    part = lambda n: F.regexp_extract(s, inside, n)
    found = F.when(s.rlike(inside), F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
    return F.coalesce(*tried, found)


def by_regex(text: Column, pattern: str, group: int | None = None) -> Column:
    """The first group, or the whole match of a pattern without groups; null without a match."""
    import re

    n = group if group is not None else min(1, re.compile(pattern).groups)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))


COERCIONS = {"trim": F.trim, "int": to_int, "float": to_float, "eur_decimal": to_eur, "bool": to_bool, "iso_date": to_iso_date}


def apply_hints(text: Column, regex: str | None = None, coerce: str | None = None, trim: bool = False) -> Column:
    """A field's hints in their order: regex, coerce, trim."""
    if coerce and coerce not in (*COERCIONS, "regex"):
        raise ValueError(f"unknown coercion {coerce!r}")
    out = by_regex(text, regex) if regex else text
    out = COERCIONS[coerce](out) if coerce in COERCIONS else out
    return F.trim(out) if trim and coerce in (None, "regex", "trim", "iso_date") else out


def first_number(text: Column) -> Column:
    """The first run of digits and dots, thousands separators dropped."""
    s = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d[\d.]*)", 1)
    return F.regexp_replace(s, r"\.+$", "").try_cast("double")


def currency(text: Column) -> Column:
    return F.when(F.instr(text, "$") > 0, F.lit("USD")).when(F.instr(text, "€") > 0, F.lit("EUR")).when(F.instr(text, "£") > 0, F.lit("GBP"))


def count_with_suffix(text: Column) -> Column:
    """1.2k -> 1200, 3M -> 3000000; null if nothing is counted."""
    s = F.lower(F.replace(F.trim(text), F.lit(","), F.lit("")))
    n = F.regexp_extract(s, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(s, r"\d+(?:\.\d+)?\s*([km])\b", 1)
    scaled = n * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    return F.nullif(F.round(scaled).cast("long"), F.lit(0).cast("long"))


def schema_short(text: Column) -> Column:
    return F.regexp_replace(text, r"^https?://schema\.org/", "")


def canonical_number(text: Column) -> Column:
    """Whole numbers keep their digits; others become the shortest form of the double."""
    return F.when(text.rlike(r"[.eE]"), F.format_string("%s", text.try_cast("double"))).otherwise(text)
