"""What a question about the catalogue asks for: intent, quantity, discount, and words for amounts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that ask for a quotation, and those that ask for a price together with a quantity.
QUOTE = ["quote", "quotation", "rfq", "invoice", "purchase\\s+invoice", "purchase\\s+order", "tax\\s+invoice", "po"]
QUOTE_WITH_QUANTITY = ["discount", "gst", "final amount", "subtotal"]
# Words that only ask.
ASKING = ["product", "item", "ki", "ke", "ka", "hai", "chahiye", "listing", "show", "details"]
ONES = [
    "", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen", "Fourteen", "Fifteen",
    "Sixteen", "Seventeen", "Eighteen", "Nineteen",
]
TENS = ["", "", "Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety"]
UNITS = "units?|qty|quantity|pieces?|pcs?"


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 to 1; no built-in has it, so it runs in Arrow batches."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def wants_quote(q: Column) -> Column:
    """Whether a question asks for a quotation: it says so, or it names a quantity and something about the price."""
    x = F.lower(F.trim(F.coalesce(q, F.lit(""))))
    priced = F.lit(False)
    for w in QUOTE_WITH_QUANTITY:
        priced = priced | x.contains(w)
    return x.rlike(rf"\b(?:{'|'.join(QUOTE)})\b") | (x.rlike(rf"\b\d+\s*(?:{UNITS})\b") & priced)


def quantity(q: Column) -> Column:
    """Number of units named, or behind ``for`` or ``of``; else null."""
    x = F.lower(F.coalesce(q, F.lit("")))
    found = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    return F.coalesce(found(rf"\b(\d+)\s*(?:{UNITS})\b"), found(r"\b(?:for|of)\s+(\d+)\b")).try_cast("long")


def discount(q: Column) -> Column:
    """First percentage as a share, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(q, F.lit("")), r"(\d+(?:\.\d+)?)\s*%", 1), F.lit("")).try_cast("double") / 100, F.lit(0.0))


def intent(q: Column, selected: Column | None = None) -> Column:
    """``quotation`` or ``search``; with a product selected, a quantity or discount asks for a quotation unless the question searches."""
    searching = F.lower(F.coalesce(q, F.lit(""))).rlike("find|search|show|list|about|product|detail|alternative|inquiry|enquiry|pricing|vendor|compare|catalog")
    follow = (selected if selected is not None else F.lit(False)) & (quantity(q).isNotNull() | (discount(q) > 0))
    return F.when(wants_quote(q), "quotation").when(~searching & follow, "quotation").otherwise("search")


def query_mode(q: Column, exact: Column, vendors: Column, products: Column) -> Column:
    """How to look up: by an exact product, a vendor, both, or products."""
    return F.when(exact, "exact_product_lookup").when(vendors & ~products, "vendor_lookup").when(vendors & products, "vendor_product_lookup").otherwise("product_lookup")


def _below_hundred(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    small = F.get(ones, F.least(n, F.lit(19)).cast("int"))
    return F.when(n < 20, small).otherwise(F.concat_ws(" ", F.get(tens, F.floor(n / 10).cast("int")), F.nullif(F.get(ones, (n % 10).cast("int")), F.lit(""))))


def words(n: Column) -> Column:
    """A whole number, 0 to below 10 ** 14, in words: crore, lakh, thousand, hundred."""
    n = n.cast("long")
    below_thousand = lambda x: F.concat_ws(" ", F.when(x >= 100, F.concat(_below_hundred(F.floor(x / 100)), F.lit(" Hundred"))), F.nullif(_below_hundred(x % 100), F.lit("")))

    def below_crore(x: Column) -> Column:
        part = lambda v, name: F.when(v > 0, F.concat(_below_hundred(v), F.lit(f" {name}")))
        return F.concat_ws(" ", part(F.floor(x / 100_000), "Lakh"), part(F.floor(x / 1000) % 100, "Thousand"), F.nullif(below_thousand(x % 1000), F.lit("")))

    crore = F.floor(n / 10_000_000)
    return F.when(n == 0, "Zero").otherwise(F.concat_ws(" ", F.when(crore > 0, F.concat(below_crore(crore), F.lit(" Crore"))), F.nullif(below_crore(n % 10_000_000), F.lit(""))))


def amount_words(amount: Column) -> Column:
    """An amount of rupees in words; below zero counts as zero."""
    paise = F.round(F.greatest(amount, F.lit(0.0)) * 100).cast("long")
    whole, rest = F.floor(paise / 100), paise % 100
    return F.concat(F.lit("INR "), words(whole), F.lit(" Rupees"), F.when(rest > 0, F.concat(F.lit(" and "), words(rest), F.lit(" Paise"))).otherwise(""), F.lit(" only"))


def recorded_price(c: Column) -> Column:
    """A single recorded amount; a range, a word or a blank is 0."""
    x = F.regexp_replace(F.replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(","), F.lit("")), r"(?i)^(?:INR|RS\.?|₹)\s*", "")
    return F.when(x.rlike(r"^\d+(?:\.\d+)?$"), x.cast("double")).otherwise(0.0)


def strict_amount(c: Column) -> Column:
    """An amount that is nothing but one: plain, or grouped in threes or in lakhs, with a currency in front at most; else null."""
    x = F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"(?i)^(?:INR|RS\.?|₹)\s*", "")
    grouped = x.rlike(r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$") | x.rlike(r"^\d{1,2}(?:,\d{2})*,\d{3}(?:\.\d+)?$")
    return F.when(x.rlike(r"^\d+(?:\.\d+)?$") | grouped, F.replace(x, F.lit(","), F.lit("")).cast("double"))


def first_number(c: Column) -> Column:
    """The first number of a text, grouping commas left out; null without one."""
    return F.replace(F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def invoice_amount(c: Column) -> Column:
    """An amount with two decimals, not negative, as an exact number; else null."""
    x = F.replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(","), F.lit(""))
    return F.when(x.rlike(r"^\d{1,12}(?:\.\d{1,2})?$"), x.cast("decimal(18,2)"))
