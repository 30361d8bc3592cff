"""Identifiers, web addresses, names and places: checks and normal forms in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

# The alphabet of GSTIN check characters, in order of value.
GSTIN_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Legal words and what they stand for.
LEGAL_WORDS = {"pvt": "private", "pvtltd": "private limited", "ltd": "limited", "llc": "limited", "inc": "incorporated", "corp": "corporation", "co": "company"}
# Legal words that may end a company's name.
LEGAL_ENDINGS = ["private", "limited", "incorporated", "corporation", "company"]
# Words that stay small inside a title.
SMALL_WORDS = ["and", "of", "the", "in", "at", "for", "on"]

_GSTIN = "^([0-9]{2})[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"


def gstin_check(first: Column) -> Column:
    """Check character of the first 14 characters: digits of base 36, every second one doubled."""
    def step(total: Column, i: Column) -> Column:
        value = F.instr(F.lit(GSTIN_ALPHABET), F.substring(first, i, F.lit(1))) - 1
        product = value * F.when(i % 2 == 1, 1).otherwise(2)
        return total + F.floor(product / 36).cast("int") + product % 36

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), step)
    return F.substring(F.lit(GSTIN_ALPHABET), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def gstin_valid(c: Column) -> Column:
    """Whether a text is a GSTIN with a known state code and the right check character; null is not."""
    g = F.upper(F.coalesce(c, F.lit("")))
    state = F.regexp_extract(g, _GSTIN, 1).try_cast("int")
    known = state.between(1, 38) | state.isin(97, 99)
    return F.when(g.rlike(_GSTIN) & known, gstin_check(F.left(g, F.lit(14))) == F.right(g, F.lit(1))).otherwise(False)


def registrations(c: Column) -> Column:
    """array<struct<rank, kind, value>> of the identifiers in a text, best kind first: gst, cin, udyam, pan, other.

    Labels such as ``GSTIN:`` are stripped; a GSTIN that fails its check is left out.
    """
    label = r"(?i)^(?:(?:udyam\s+registration\s+(?:no|number)|gstin|gst|cin|pan|reg(?:istration)?|licen[cs]e|no|number|id)\b[\s.:#\-]*)+"
    parts = F.split(T.strip_null_like(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n|\s{2,}", ";")), "[,;|]+")

    udyam = "^UDYAM([A-Z]{2})([0-9]{2})([0-9]{7})$"
    make = lambda rank, kind, value: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), value.alias("value"))

    def read(v: Column) -> Column:
        return (
            F.when(v.rlike(_GSTIN), F.when(gstin_valid(v), make(0, "gst", v)))
            .when(v.rlike(udyam), make(2, "udyam", F.regexp_replace(v, udyam, "UDYAM-$1-$2-$3")))
            .when(v.rlike("^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"), make(1, "cin", v))
            .when(v.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), make(3, "pan", v))
            .when(v.rlike("^[A-Z0-9/]{5,}$") & v.rlike("[0-9]"), make(4, "other", v))
        )

    values = F.transform(parts, lambda p: F.upper(F.regexp_replace(F.regexp_replace(F.trim(p), label, ""), r"[\s\-_.]", "")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(values, read))))


def website(c: Column) -> Column:
    """Host without ``www.`` and path without ending slashes, lower-cased host; empty if it is no address."""
    return website_of(T.strip_null_like(c))


def website_of(x: Column) -> Column:
    """``website`` of a text that ``strip_null_like`` gave."""
    x = F.regexp_replace(x, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(x, r"^([^/?#\s]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(x, r"^[^/?#\s]*(/[^?#\s]*)", 1), "/+$", "")
    return F.when(host.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"), F.concat(host, path)).otherwise("")


def host(c: Column) -> Column:
    """Lower-cased host of an address, null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def title_case(c: Column) -> Column:
    """Each word with a capital; small words stay small but at the start."""
    words = F.filter(F.split(F.lower(T.squeeze(c)), " "), lambda w: w != "")
    big = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(big(w))), " ")


def company_key(c: Column) -> Column:
    """Key of a company's name: list numbering dropped, lower case, marks as spaces."""
    name = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\s*(?:\(?[0-9]+\)?\s*[.)_-]\s*|[0-9]+\s+)", "")
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)[\W_]+", " "))


def company_core(c: Column) -> Column:
    """Up to six words of a company's key with legal words spelt out and those at its end dropped."""
    spelt = F.create_map(*[F.lit(x) for kv in LEGAL_WORDS.items() for x in kv])
    words = F.flatten(F.transform(F.filter(F.split(company_key(c), " "), lambda w: w != ""), lambda w: F.split(F.coalesce(F.try_element_at(spelt, w), w), " ")))
    last = F.array_max(F.transform(words, lambda w, i: F.when(~w.isin(LEGAL_ENDINGS), i + 1).otherwise(0)))
    return F.slice(words, F.lit(1), F.least(F.coalesce(last, F.lit(0)), F.lit(6)))


def company_from_path(path: Column, generic: list[str]) -> Column:
    """First folder of a path that is neither generic nor a number, else null; the file itself is no folder."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    keep = F.filter(folders, lambda p: ~company_key(p).isin(["", *generic]) & ~company_key(p).rlike("^[0-9]+$"))
    return F.try_element_at(keep, F.lit(1))


# Words of headers and totals that are no names.
NOT_NAMES = [
    "name", "sr no", "sr", "sno", "s no", "sl no", "slno", "serial no", "serial number", "total", "grand total", "sub total", "subtotal",
    "hospital name", "company name", "name of hospital", "name of company", "address", "city", "state", "district", "phone", "email", "contact",
    "remarks", "note", "notes", "page", "no", "s n", "particulars", "description", "details", "entity name", "organization", "organisation",
]


#: Fixed value: a page number or a page of pages.
PAGE_FOOTER = r"^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$"


def name_problem(c: Column) -> Column:
    """Issue of a name, else null: missing_name, invalid_name (header, number, too short, no letter) or suspicious_name (over 160 characters)."""
    return problem_of(T.squeeze(c), T.normal(c))


def problem_of(x: Column, n: Column) -> Column:
    """``name_problem`` of a name that ``squeeze`` gave and its normal form."""
    return (
        F.when(n == "", "missing_name")
        .when(n.isin(NOT_NAMES) | n.rlike(PAGE_FOOTER) | n.rlike("^[0-9 ]+$") | (F.length(n) < 2), "invalid_name")
        .when(F.length(x) > 160, "suspicious_name").when(~x.rlike(r"\p{L}"), "invalid_name")
    )


def ordered_json(m: Column) -> Column:
    """JSON of a map with its keys in order, so that equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
