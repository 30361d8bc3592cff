"""Scalar expressions for names, contact details, identifiers and similarity; all JVM-side."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that stand for a missing value.
NULL_LIKE = [
    "", "n/a", "na", "n.a", "n.a.", "nil", "none", "null", "nan", "-", "--", "---", ".", "..", "not available", "not applicable",
    "not provided", "not given", "unknown", "?", "??", "no", "#n/a", "#ref!", "#value!", "<na>",
]


def _single_forms() -> tuple[str, str]:
    """Characters that stand for one other under compatibility (full-width marks, odd spaces, raised digits), and those others."""
    pairs = [(ch, unicodedata.normalize("NFKC", ch)) for lo, hi in ((0x00A0, 0x00C0), (0x2000, 0x2080), (0x3000, 0x3001), (0xFF01, 0xFF5F)) for ch in map(chr, range(lo, hi))]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_WIDE, _PLAIN = _single_forms()


@F.pandas_udf(StringType())
def compose(texts: pd.Series) -> pd.Series:
    """NFKC, in Arrow batches: for columns that may hold letters with separate marks, which no built-in composes."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Compatibility forms of single characters become plain, zero-width marks go, control characters and runs of white space become one space."""
    plain = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "[\u200B\u200C\u200D\u2060\uFEFF]", ""), _WIDE, _PLAIN)
    return F.trim(F.regexp_replace(plain, "(?U)[\\s\\p{Cntrl}]+", " "))


def squeeze_odd(c: Column) -> Column:
    """``squeeze`` of a column, by a single search where its text is printable ASCII with single spaces."""
    return F.when(c.rlike("[^ -~]|  "), squeeze(c)).otherwise(F.trim(F.coalesce(c, F.lit(""))))


def strip_null_like(c: Column) -> Column:
    """An empty string for values that only say that there is none."""
    return given(squeeze(c))


def given(x: Column) -> Column:
    """``strip_null_like`` of a text that ``squeeze`` gave."""
    return F.when(F.lower(x).isin(NULL_LIKE), "").otherwise(x)


def normal(c: Column) -> Column:
    """Lower case, ``&`` as a word, apostrophes dropped, other marks as spaces."""
    return plain(strip_null_like(c))


def plain(x: Column) -> Column:
    """``normal`` of a text that ``strip_null_like`` gave."""
    x = F.regexp_replace(F.regexp_replace(F.lower(x), "&", " and "), "['’`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^\\p{L}\\p{M}\\p{N}\\s]+", " "), "\\s+", " "))


def plain_odd(c: Column) -> Column:
    """``plain`` of a lower-cased column, by a single search where its text is words of Latin letters and digits."""
    return F.when(c.rlike("[^a-z0-9 ]|  "), plain(c)).otherwise(F.trim(c))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normal(c), " "), lambda t: t != "")


def acronym(c: Column) -> Column:
    """First letters of two alphabetic words or more, else empty."""
    t = tokens(c)
    ok = (F.size(t) >= 2) & ~F.exists(t, lambda w: ~w.rlike("^\\p{L}+$"))
    return F.when(ok, F.array_join(F.transform(t, lambda w: F.left(w, F.lit(1))), "")).otherwise("")


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by one row of the table per character of ``a``."""
    xs, ys = F.split(a, ""), F.split(b, "")

    def row(prev: Column, x: Column) -> Column:
        step = F.aggregate(
            F.arrays_zip(ys.alias("y"), prev.alias("up"), F.slice(F.concat(F.array(F.lit(0)), prev), F.lit(1), F.size(prev)).alias("diag")),
            F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("out")),
            lambda acc, z: F.struct(
                F.when(z["y"] == x, z["diag"] + 1).otherwise(F.greatest(z["up"], acc["left"])).alias("left"),
                F.concat(acc["out"], F.array(F.when(z["y"] == x, z["diag"] + 1).otherwise(F.greatest(z["up"], acc["left"])))).alias("out")),
            lambda acc: acc["out"],
        )
        return step

    last = F.aggregate(xs, F.transform(ys, lambda _: F.lit(0)), row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(last, -1))


def ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (lengths together); 100 for two empty strings."""
    n = F.length(a) + F.length(b)
    return F.when(a == b, 100.0).when(n == 0, 100.0).otherwise(200.0 * lcs(a, b) / n)


def token_sort_ratio(a: Column, b: Column) -> Column:
    order = lambda c: F.array_join(F.array_sort(tokens(c)), " ")
    return ratio(order(a), order(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared words alone and with either side's rest; 0 if a side has no words, 100 if one holds the other."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both, left, right = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    text = lambda *parts: F.array_join(F.concat(*[F.array_sort(p) for p in parts]), " ")
    base, one, two = text(both), text(both, left), text(both, right)
    rest = ratio(one, two)
    best = F.when(F.size(both) == 0, rest).otherwise(F.greatest(ratio(base, one), ratio(base, two), rest))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((F.size(both) > 0) & ((F.size(left) == 0) | (F.size(right) == 0)), 100.0).otherwise(best)


def emails(c: Column) -> Column:
    """Distinct lower-cased addresses without double dots."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda e: ~e.contains("..")))


# Numbers that nobody has.
PLACEHOLDER_PHONES = ["1234567890", "0123456789", "9876543210", "0987654321"]
# Mailbox names that only fill a field.
PLACEHOLDER_LOCALS = ["na", "none", "null", "noemail", "nomail", "no", "test", "abc", "xyz", "xxx", "email", "mail", "nil"]


def phone_parts(c: Column) -> Column:
    """array<struct<raw, number, kind>> of the numbers in a text: ``valid`` (national ten digits), ``placeholder`` or ``invalid``.

    Numbers part at commas, slashes and the like, at "and" and "or", and, where
    there are too many digits for one, before a mobile number after a space.  Labels in front go; a number that a
    spreadsheet wrote as 9414012345.0 or 9.414012345E9 is read as written there.
    Valid are mobiles (6 to 9 first) and ten digits of area code and number
    after a leading zero or the country's code.
    """
    several = lambda p: F.when(F.length(F.regexp_replace(p, "[^0-9]", "")) > 13, F.split(p, r"\s{2,}|\s(?=[6-9][0-9]{9}(?![0-9]))")).otherwise(F.array(p))
    parts = F.flatten(F.transform(F.split(strip_null_like_lines(c), r"(?i)[,;/|\n]+|\s+(?:and|or)\s+"), several))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")

    def read(p: Column) -> Column:
        whole = F.when(p.rlike(r"^[0-9]+\.0+$"), F.regexp_replace(p, r"\.0+$", "")).when(
            p.rlike(r"^[0-9](?:\.[0-9]+)?[eE]\+?[0-9]+$"), p.try_cast("decimal(30,0)").cast("string")).otherwise(F.regexp_replace(p, r"^[A-Za-z][A-Za-z .:\-()/]*?(?=[+(]?[0-9])", ""))
        return let(whole, lambda w: let(F.regexp_replace(w, "[^0-9]", ""), lambda digits: let(
            F.regexp_replace(digits, "^(?:0+|0*91(?=[0-9]{10}$))", ""), lambda short: let(kind(digits, short), lambda k: F.struct(
                F.trim(w).alias("raw"), F.when(k == "valid", short).otherwise(digits).alias("number"), k.alias("kind"))))))

    def kind(digits: Column, short: Column) -> Column:
        tail = F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits)
        mobile, landline = short.rlike("^[6-9][0-9]{9}$"), short.rlike("^[1-5][0-9]{9}$") & digits.rlike("^(?:0|91)")
        return F.when(digits == "", "invalid").when(tail.rlike("^([0-9])\\1*$") | tail.isin(PLACEHOLDER_PHONES), "placeholder").when(mobile | landline, "valid").otherwise("invalid")

    return F.transform(parts, read)


def strip_null_like_lines(c: Column) -> Column:
    """``strip_null_like`` that leaves white space inside alone."""
    x = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(squeeze(c)).isin(NULL_LIKE), "").otherwise(x)


def email_parts(c: Column) -> Column:
    """array<struct<raw, address, valid>> of what looks like an address; a text without any is one invalid part."""
    return email_parts_of(strip_null_like(c))


def email_parts_of(x: Column) -> Column:
    """``email_parts`` of a text that ``strip_null_like`` gave."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"[^\s,;<>()\[\]\"'|]+@[^\s,;<>()\[\]\"'|]+"), F.lit(0)), lambda t: F.regexp_replace(t, "^[.:-]+|[.:-]+$", ""))
    parts = F.when((F.size(found) == 0) & (x != ""), F.array(x)).otherwise(found)
    good = r"^[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$"
    return F.transform(parts, lambda t: F.struct(t.alias("raw"), F.lower(t).alias("address"), (t.rlike(good) & ~t.contains("..") & ~F.substring_index(F.lower(t), "@", 1).isin(PLACEHOLDER_LOCALS)).alias("valid")))


def phones(c: Column) -> Column:
    """Ten-digit national numbers: mobiles start 6 to 9; country code and leading zeros dropped; placeholders refused."""
    parts = F.split(F.coalesce(c, F.lit("")), "[/,;|]")
    digits = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, "\\.0$", ""), "[^0-9]", ""))
    cut = F.transform(digits, lambda d: F.regexp_replace(d, "^(?:0+|91(?=[0-9]{10}$))", ""))
    return F.array_distinct(F.filter(cut, lambda d: d.rlike("^[1-9][0-9]{9}$") & ~d.rlike("^([0-9])\\1{9}$")))


def pincode(c: Column) -> Column:
    """A six-digit postal code, with or without a gap, else empty."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), "(?<![0-9])([1-9][0-9]{2} ?[0-9]{3})(?![0-9])", 1), " ", "")


def price(c: Column) -> Column:
    """A single amount as a number; ranges, words and blanks give null."""
    x = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^(?:₹|rs\\.?|inr)\\s*|,", "")
    return F.when(x.rlike("^[0-9]+(\\.[0-9]+)?$"), x.cast("double"))


def guard_formula(c: Column, style: str = "all") -> Column:
    """Text that a spreadsheet would run gets a quote in front.

    ``export``: first character ``=`` or ``@``; ``stripped``: any of six after
    leading blanks; ``all``: any of six at the start.
    """
    pattern = {"export": "^[=@]", "stripped": "^ *[=+\\-@\\t\\r]", "all": "^[=+\\-@\\t\\r]"}[style]
    return F.when(c.rlike(pattern), F.concat(F.lit("'"), c)).otherwise(c)


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs of any length order as numbers: each is its length, then its digits."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 9, "0"), number(p))).otherwise(p)), "")


def passages(c: Column, step: int = 1000, size: int = 1200) -> Column:
    """Overlapping passages of a text."""
    n = F.greatest(F.length(c), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: F.substring(c, s + 1, F.lit(size)))


def safe_name(c: Column, limit: int = 80) -> Column:
    """A file-system safe name."""
    return F.left(F.coalesce(F.nullif(F.trim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")), F.lit("")), F.lit("unnamed")), F.lit(limit))
