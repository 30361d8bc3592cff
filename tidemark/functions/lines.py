"""Free lines to fields: what stands in a line of text about an organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import places as P
from tidemark.functions import text as T
from tidemark.operators import schema as S

EMAIL = r"(?i)(?:e-?mail\s*[:\-]?\s*)?([a-z0-9][a-z0-9._%+\-]*@(?:[a-z0-9\-]+\.)+[a-z]{2,24})"
URL = r"(?i)(?:web(?:site)?\s*[:\-]?\s*)?((?:https?://|www\.)[^\s,;|]+)"
REGISTRATIONS = (
    r"(?i)(?:gst(?:in)?(?:\s*no\.?)?\s*[:\-]?\s*)?\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b",
    r"(?i)(?:udyam(?:\s*(?:registration\s*)?no\.?)?\s*[:\-]?\s*)?\b(UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7})\b",
    r"(?i)(?:cin\s*[:\-]?\s*)?\b([LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6})\b",
)
PHONE = r"(?i)(?:(?:ph(?:one)?|tel|mob(?:ile)?|contact)(?:\s*no)?\.?\s*[:\-]?\s*|(?<![\p{L}0-9]))(\+?[0-9(][0-9\s().\-]{6,16}[0-9])"
PIN = r"(?i)(?:pin(?:\s*code)?\s*[:\-]?\s*|(?<![\p{L}0-9]))([1-9][0-9]{2}\s?[0-9]{3})(?![0-9])"
EDGE = r"^[\s\-–—:;,.|*•]+|[\s\-–—:;,|*•]+$"
#: A number in front of a name, of any length; it goes before contacts are lifted, which it may look like.
NUMBERED = r"^\s*\(?[0-9]+[.)]\s+(?=\p{L})"
MARKER = r"^\s*(?:\(?[0-9]{1,4}[.)]|[-*•])\s+"
LABEL = r"^\s*([\p{L}][\p{L} ./()&\-]{0,40}?)\s*[:=]\s*(.+)$"


def _struct(**c: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in c.items()])


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _all(pattern: str, c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))


def parse(c: Column, gazetteer: P.Gazetteer = P.Gazetteer()) -> Column:
    """struct of name, city, state, address, pincode, phone, email, website and registration_id of a line; what is not there is empty.

    Contacts and identifiers are lifted out first; the rest parts at the first
    of ``| tab ; ,`` that it has, else at a dash between blanks.  A number in
    front goes; the first part is the name, and of the others those that are a
    known state or city are these, the rest is the address.
    """
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))

    def lifted(x: Column) -> Column:
        emails = _all(EMAIL, x)
        x1 = F.regexp_replace(x, EMAIL, " ")
        urls, x2 = _all(URL, x1), F.regexp_replace(x1, URL, " ")
        regs, x3 = F.concat(*[_all(p, x2) for p in REGISTRATIONS]), x2
        for p in REGISTRATIONS:
            x3 = F.regexp_replace(x3, p, " ")
        numbers = F.filter(_all(PHONE, x3), lambda n: digits(n).between(8, 13))
        # numbers of another length stay where they are
        x4 = F.regexp_replace(x3, r"(?i)(?:(?:ph(?:one)?|tel|mob(?:ile)?|contact)(?:\s*no)?\.?\s*[:\-]?\s*|(?<![\p{L}0-9]))\+?(?:[(]?[0-9][\s().\-]{0,2}){7,12}[0-9](?![0-9])", " ")
        return _struct(emails=emails, urls=urls, regs=regs, phones=numbers, pins=_all(PIN, x4), rest=F.regexp_replace(x4, PIN, " "))

    def parted(x: Column) -> Column:
        cut = F.when(x.contains("|"), F.split(x, r"\|")).when(x.contains("\t"), F.split(x, "\t")).when(x.contains(";"), F.split(x, ";")).when(x.contains(","), F.split(x, ",")).otherwise(F.split(x, r"\s[-–—]\s"))
        parts = F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: F.regexp_replace(p, EDGE, "") != "")
        return F.when((F.size(parts) >= 2) & F.get(parts, F.lit(0)).rlike(r"^[0-9]{1,5}[.)]?$"), F.slice(parts, 2, F.size(parts))).otherwise(parts)

    def named(parts: Column) -> Column:
        """A known place behind the last comma of the first part is no part of the name."""
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        tail = F.trim(F.regexp_extract(first, r",([^,]*)$", 1))
        place = first.contains(",") & (T.normal(tail).isin(list(gazetteer.aliases())) | gazetteer.city(tail).isin(list(gazetteer.city_states())))
        return F.when(place, F.concat(F.array(F.trim(F.regexp_replace(first, r",[^,]*$", "")), tail), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))).otherwise(parts)

    def fields(l: Column, parts: Column) -> Column:
        others = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.regexp_replace(p, EDGE, "")), lambda p: p != "")
        is_state = lambda p: T.normal(p).isin(list(gazetteer.aliases()))
        is_city = lambda p: gazetteer.city(p).isin(list(gazetteer.city_states()))
        states = F.filter(others, is_state)
        # the first state is the state; a further one may still be a city
        kind = F.transform(others, lambda p: _struct(p=p, k=F.when(is_state(p) & (p == F.get(states, F.lit(0))), "state").when(is_city(p), "city").otherwise("address")))
        cities = F.filter(kind, lambda x: x["k"] == "city")
        rest = F.filter(kind, lambda x: (x["k"] == "address") | ((x["k"] == "city") & (x["p"] != F.get(cities, F.lit(0))["p"])))
        raw = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), MARKER, ""), EDGE, ""), r"\s+", " "))
        or_empty = lambda x: F.coalesce(x, F.lit(""))
        return _struct(
            name=F.when(raw.rlike(r"\p{L}"), raw).otherwise(""), city=or_empty(F.get(cities, F.lit(0))["p"]), state=or_empty(F.get(states, F.lit(0))),
            address=F.array_join(F.transform(rest, lambda x: x["p"]), ", "), pincode=or_empty(F.get(l["pins"], F.lit(0))), phone=F.array_join(l["phones"], " / "),
            email=F.array_join(l["emails"], "; "), website=F.array_join(l["urls"], " "), registration_id=F.array_join(l["regs"], "; "))

    return _let(T.squeeze(F.replace(F.coalesce(c, F.lit("")), F.lit("\t"), F.lit(" | "))), lambda x: _let(lifted(F.regexp_replace(x, NUMBERED, "")), lambda l: _let(named(parted(l["rest"])), lambda parts: fields(l, parts))))


def role(text: Column, fields: Column, heading: Column, keyword: Column, title: tuple[str, ...] = ("list", "annexure", "report", "directory", "index"), generic: bool = False) -> Column:
    """What a line is: heading, prose, title_or_note or entity; only an entity's line names one.

    ``keyword``: whether its name has a word of organisations.
    """
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    other = F.lit(False)
    for k in ("city", "state", "pincode", "phone", "email", "website", "registration_id"):
        other = other | (fields[k] != "")
    titled = F.arrays_overlap(F.transform(words, lambda w: F.lower(w)), F.array(*map(F.lit, title)))
    bare = F.when(titled, "title_or_note").when(keyword, "entity").when(F.lit(generic) & (F.size(words) <= 6), "entity").otherwise("title_or_note")
    return (
        F.when(heading & ~other, "heading").when((F.size(words) >= 14) | ((F.size(words) >= 6) & F.trim(text).rlike(r"[.!?]$") & ~other), "prose")
        .when(fields["name"] == "", "title_or_note").when(~other, bare).otherwise("entity"))


def labelled(lines: DataFrame, block: list[str], order: str, text: str, spelling: S.Spelling = S.Spelling()) -> DataFrame:
    """Lines with the label (``Label: value``) that they carry and its field: label, value, field."""
    lined = lines.withColumn("label", F.regexp_extract(T.squeeze(F.col(text)), LABEL, 1)).withColumn("value", F.regexp_extract(T.squeeze(F.col(text)), LABEL, 2))
    fields = S.header_fields(lined.where("label <> ''"), "label", spelling).select("label", "field")
    return lined.join(fields, "label", "left").select(*block, order, text, "label", "value", "field")


def label_blocks(lines: DataFrame, block: list[str]) -> DataFrame:
    """(block, mode): ``label`` if three lines or more carry a known label and one of them is a name, else ``line``."""
    counted = lines.groupBy(*block).agg(F.count("field").alias("n"), F.max((F.col("field") == "name").cast("int")).alias("named"))
    return counted.select(*block, F.when((F.col("n") >= 3) & (F.col("named") == 1), "label").otherwise("line").alias("mode"))


def label_records(lines: DataFrame, block: list[str], order: str, text: str) -> DataFrame:
    """Records of ``labelled`` lines of label blocks: a second name starts the next record; fields' values are joined, other lines kept.

    (block, record, first, values: map of field to text, unlabelled).
    """
    new = (F.col("field") == "name").cast("int")
    seen = F.sum(F.coalesce(new, F.lit(0))).over(Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # lines before the first name belong to the first record
    placed = lines.withColumn("record", F.greatest(seen, F.lit(1)))
    per = placed.groupBy(*block, "record", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.when(F.col("field").isNull(), F.col(text)).otherwise(F.col("value")).alias("v")))), lambda x: x["v"]).alias("v"), F.min(order).alias("first"))
    joined = per.withColumn("joined", F.coalesce(*[F.when(F.col("field") == f, S.join_values(F.col("v"), f)) for f in S.ALIASES], F.array_join("v", " | ")))
    return joined.groupBy(*block, "record").agg(
        F.min("first").alias("first"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "joined"))))).alias("values"),
        F.max(F.when(F.col("field").isNull(), F.col("joined"))).alias("unlabelled"))
