"""Header and column mapping: which column of a table holds which field, and how sure that is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import validate as V

# Spellings of fields in headers.
ALIASES = {
    "name": ["name", "entity name", "entity", "hospital name", "hospital", "name of hospital", "company name", "company", "firm name", "vendor name"],
    "address": ["address", "addr", "full address", "complete address", "postal address", "street address"],
    "city": ["city", "town", "city town", "city name", "town city", "village"],
    "district": ["district", "dist", "district name", "zila"],
    "state": ["state", "state name", "st", "state ut", "province"],
    "pincode": ["pincode", "pin code", "pin", "zip", "zip code", "postal code"],
    "phone": ["phone", "phone no", "phone number", "phone 1", "phone 2", "mobile", "mobile no", "contact no", "telephone"],
    "email": ["email", "e mail", "email id", "e mail id", "email address", "mail"],
    "website": ["website", "web site", "web", "url", "web address", "website url"],
    "registration_id": ["registration id", "registration no", "registration number", "reg no", "reg number", "reg id", "gstin", "gst no"],
    "category": ["category", "type", "entity type", "hospital type", "type of hospital", "type of institution"],
}
# Words of headers that name a person or an account, never the entity.
NEVER_NAME = [
    "contact person", "person", "owner", "proprietor", "director", "doctor name", "name of doctor", "authorised", "authorized", "signatory",
    "representative", "father", "guardian", "in charge", "incharge", "head", "medical superintendent", "ms name", "cmo", "bank", "account", "ifsc",
    "designation", "employee", "patient", "applicant", "user",
]
# Fixed values: (field, all words needed, phrases) in the order in which they are tried.
KEYWORDS = (
    ("name", False, ("hospital name", "company name", "firm name", "institution name", "organisation name", "organization name", "name of hospital", "name of institution", "name of company", "entity name")),
    ("email", False, ("email", "e mail", "mail id")), ("website", False, ("website", "web site", "url", "homepage")),
    ("phone", False, ("phone", "mobile", "telephone", "contact no", "contact number", "tel no", "cell", "landline", "helpline")),
    ("pincode", False, ("pincode", "pin code", "zip", "postal code")),
    ("registration_id", False, ("gstin", "gst no", "gst number", "udyam", "registration no", "registration number", "reg no", "licence no", "license no")),
    ("address", False, ("address",)), ("district", False, ("district",)), ("state", True, ("state",)), ("city", False, ("city", "town")), ("category", False, ("category", "type of")),
)
SINGLE = ["name", "city", "district", "state", "pincode", "category"]
SEPARATORS = {"address": ", ", "phone": " / ", "email": "; ", "website": " ", "registration_id": "; "}


@dataclass(frozen=True)
class Spelling:
    """What a mapper knows; ``overrides`` maps a header, or ``file::header``, to a field or to ``ignore``."""

    aliases: dict[str, list[str]] = field(default_factory=lambda: ALIASES)
    never_name: tuple[str, ...] = tuple(NEVER_NAME)
    keywords: tuple = KEYWORDS
    overrides: dict[str, str] = field(default_factory=dict)
    least: float = 90.0

    def by_alias(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for f, names in self.aliases.items():
            for n in names:
                out.setdefault(n, f)
        return out


def _in(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("string")


def match_header(header: Column, spelling: Spelling = Spelling(), file: Column | None = None) -> Column:
    """struct(field, confidence, method) of a header: override, exact alias, keyword, close alias, or none.

    A close alias is at least ``least`` alike; of equally close ones the first
    counts.  Headers that name a person are never the entity's name.
    """
    plain, n, table = T.squeeze(header), T.normal(header), spelling.by_alias()
    padded = F.concat(F.lit(" "), n, F.lit(" "))
    holds = lambda p: padded.contains(f" {p} ")
    person = F.lit(False)
    for word in spelling.never_name:
        person = person | holds(word)
    named = {k.split("::")[-1].strip().lower(): v for k, v in spelling.overrides.items() if "::" not in k}
    forced = F.coalesce(_in(spelling.overrides, F.concat_ws("::", file if file is not None else F.lit(""), plain)), _in(spelling.overrides, plain), _in(named, n))
    result = lambda f, c, m: F.struct(f.cast("string").alias("field"), F.lit(c).cast("double").alias("confidence") if not isinstance(c, Column) else c.cast("double").alias("confidence"), F.lit(m).alias("method"))
    nothing = result(F.lit(None), 0.0, "none")
    exact = _in(table, n)
    rules = []
    for f, every, phrases in spelling.keywords:
        ok = F.lit(every)
        for p in phrases:
            ok = (ok & holds(p)) if every else (ok | holds(p))
        rules.append(F.when(ok & ~(person if f == "name" else F.lit(False)), result(F.lit(f), 0.8 if every else 0.85, "keyword")))
    long = [a for a in table if len(a) >= 4]
    close = F.array_max(F.transform(F.array(*map(F.lit, long)), lambda a, i: F.struct(T.ratio(n, a).alias("score"), (-i).alias("at"), a.alias("alias"))))
    found = F.when(close["score"] >= spelling.least, _in(table, close["alias"]))
    fuzzy = F.when((F.length(n) >= 4) & found.isNotNull() & ~(person & (found == "name")), result(found, F.round(close["score"] / 100 * 0.9, 2), "fuzzy"))
    return (
        F.when(plain == "", nothing).when(forced.isNotNull(), result(F.nullif(forced, F.lit("ignore")), 1.0, "override")).when(n == "", nothing)
        .when(exact.isNotNull(), F.when(person & (exact == "name"), nothing).otherwise(result(exact, 1.0, "exact"))).otherwise(F.coalesce(*rules, fuzzy, nothing)))


def header_fields(cells: DataFrame, text: str, spelling: Spelling = Spelling()) -> DataFrame:
    """(text, field, confidence, method) of the distinct texts of a column, so that each is matched once."""
    return cells.select(text).distinct().withColumn("_m", match_header(F.col(text), spelling)).select(text, "_m.*")


def header_rows(rows: DataFrame, block: list[str], spelling: Spelling = Spelling(), within: int = 40) -> DataFrame:
    """(block, header_row, known): the row of a block (row, cells) with most distinct fields.

    Rows count within the first ``within``, with two filled cells or more of
    which at most half are numbers; two fields are needed, or one that is the
    name; the first of equal rows counts.
    """
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    top = rows.where(F.col("row") <= within).select(*block, "row", filled.alias("cells")).where(F.size("cells") >= 2)
    numbers = F.size(F.filter("cells", lambda c: c.rlike(r"^[\d.,\-/\s]+$")))
    top = top.where(numbers <= F.size("cells") / 2)
    one = top.select(*block, "row", F.explode("cells").alias("cell")).where(F.length("cell") <= 60)
    known = one.join(header_fields(one, "cell", spelling).where("field is not null"), "cell").groupBy(*block, "row").agg(F.collect_set("field").alias("fields"))
    good = known.where((F.size("fields") >= 2) | F.array_contains("fields", "name"))
    return good.groupBy(*block).agg(F.max_by(F.struct("row", F.size("fields").alias("known")), F.struct(F.size("fields"), (-F.col("row")).alias("r"))).alias("b")).select(*block, F.col("b.row").alias("header_row"), "b.known")


def sniff(values: Column, least: float = 0.6) -> Column:
    """The field that a column's values look like, by share of those filled (two at least): email, website, registration_id, phone; else null."""
    v = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    share = lambda test: F.size(F.filter(v, test)) / F.size(v)
    unique = lambda x: F.exists(V.registrations(x), lambda r: r["kind"].isin("gst", "cin", "udyam", "pan"))
    phone = lambda x: x.rlike(r"^\+?[\d\s\-().]{8,16}$") & F.length(F.regexp_replace(x, r"\D", "")).isin(10, 11, 12)
    return F.when(F.size(v) >= 2, F.when(share(lambda x: x.rlike(r"@[^@]*\.[^@]*$")) >= least, "email").when(share(lambda x: x.rlike(r"(?i)^(https?://|www\.)\S+$")) >= least, "website")
                  .when(share(unique) >= least, "registration_id").when(share(phone) >= least, "phone"))


def map_columns(columns: DataFrame, block: list[str], spelling: Spelling = Spelling(), file: Column | None = None) -> DataFrame:
    """(block, idx, header, field, confidence, method, used) of columns (idx, header, sample: array<string>).

    Headers that say nothing are judged by content (0.6); a block without a
    name takes its most text-like, most varied column (0.5).  A field with one
    value keeps its surest column, of equals the leftmost.
    """
    m = columns.withColumn("_m", match_header(F.col("header"), spelling, file)).withColumn("_s", sniff(F.col("sample")))
    content = F.col("_m.field").isNull() & (F.col("_m.method") == "none") & F.col("_s").isNotNull()
    m = m.select(*block, "idx", "header", "sample", F.when(content, F.col("_s")).otherwise(F.col("_m.field")).alias("field"), F.when(content, 0.6).otherwise(F.col("_m.confidence")).alias("confidence"), F.when(content, "content").otherwise(F.col("_m.method")).alias("method"))
    v = F.filter(F.transform("sample", lambda x: F.trim(x)), lambda x: x != "")
    texty = F.size(F.filter(v, lambda x: x.rlike(r"\p{L}{3,}"))) / F.size(v)
    varied = F.size(F.array_distinct(F.transform(v, lambda x: F.lower(x)))) / F.size(v)
    # all the columns of a block lie together; blocks are many and narrow
    here = Window.partitionBy(*block)
    guess = F.when(F.col("field").isNull() & (F.size(v) >= 3) & (texty >= 0.7) & (varied >= 0.5), F.struct((texty * 0.7 + varied * 0.3).alias("score"), (-F.col("idx")).alias("at")))
    m = m.withColumn("_named", F.max(F.coalesce(F.col("field") == "name", F.lit(False))).over(here)).withColumn("_g", guess)
    best = ~F.col("_named") & F.col("_g").isNotNull() & (F.col("_g") == F.max("_g").over(here))
    m = m.withColumn("_best", F.coalesce(best, F.lit(False)))
    m = m.select(*block, "idx", "header", F.when(F.col("_best"), "name").otherwise(F.col("field")).alias("field"), F.when(F.col("_best"), 0.5).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("_best"), "content").otherwise(F.col("method")).alias("method"))
    first = F.row_number().over(Window.partitionBy(*block, "field").orderBy(F.desc("confidence"), "idx")) == 1
    return m.withColumn("used", F.col("field").isNotNull() & (~F.col("field").isin(SINGLE) | first))


def join_values(values: Column, name: str) -> Column:
    """The filled values of several columns of one field as one text."""
    return F.array_join(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), SEPARATORS.get(name, "; "))


def unique_headers(headers: DataFrame, block: list[str], gap: str = "__") -> DataFrame:
    """Headers (idx, header) without blanks and repeats: ``column_i`` for a blank, and a number behind each repeat."""
    named = headers.withColumn("header", F.when(F.trim(F.coalesce("header", F.lit(""))) == "", F.concat(F.lit("column_"), (F.col("idx") + 1).cast("string"))).otherwise(F.trim("header")))
    n = F.row_number().over(Window.partitionBy(*block, F.lower("header")).orderBy("idx"))
    return named.withColumn("_n", n).withColumn("header", F.when(F.col("_n") > 1, F.concat_ws(gap, "header", F.col("_n").cast("string"))).otherwise(F.col("header"))).drop("_n")


def carried_headers(blocks: DataFrame, file: list[str], order: str) -> DataFrame:
    """Blocks (header: array or null, first: cells of the first row, known: fields known in it) with the header they inherit.

    A block without a header takes the last one of its file, if their widths
    differ by one at most and its first row holds fewer than two known fields.
    """
    last = F.last("header", ignorenulls=True).over(Window.partitionBy(*file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    fits = (F.abs(F.size("_last") - F.size("first")) <= 1) & (F.col("known") < 2)
    return blocks.withColumn("_last", last).withColumn("carried", F.col("header").isNull() & F.coalesce(F.col("_last").isNotNull() & fits, F.lit(False))).withColumn(
        "header", F.when(F.col("carried"), F.col("_last")).otherwise(F.col("header"))).drop("_last")


def data_rows(rows: DataFrame, headers: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (row, cells) below their block's header (header_row, header) without blanks and repeats of it, and (block, blank, repeated) counts of those."""
    plain = lambda a: F.transform(a, lambda c: F.lower(F.trim(c)))
    joined = rows.join(headers, block).where(F.col("row") > F.col("header_row"))
    kind = F.when(~F.exists("cells", lambda c: F.trim(c) != ""), "blank").when(plain("cells") == plain("header"), "repeated").otherwise("data")
    judged = joined.withColumn("_kind", kind)
    counts = judged.groupBy(*block).agg(F.count_if(F.col("_kind") == "blank").alias("blank"), F.count_if(F.col("_kind") == "repeated").alias("repeated"))
    return judged.where("_kind = 'data'").drop("_kind"), counts


def records(rows: DataFrame, mapped: DataFrame, block: list[str]) -> DataFrame:
    """One record per row (row, cells): its fields joined by their separators, all cells by header, and an id that follows from the place.

    ``mapped`` comes from ``map_columns``; cells beyond the headers are kept as ``extra_i``.
    """
    fields = list(ALIASES)
    width = mapped.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("idx", "header", "field", "used"))).alias("_cols"))
    joined = rows.join(width, block)
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", (i + 1).cast("int")), F.lit("")))
    of = lambda f: join_values(F.transform(F.filter("_cols", lambda c: c["used"] & (c["field"] == f)), lambda c: cell(c["idx"])), f)
    known = F.transform("_cols", lambda c: F.struct(c["header"].alias("key"), cell(c["idx"]).alias("value")))
    extra = F.transform(F.slice("cells", F.size("_cols") + 1, F.greatest(F.size("cells") - F.size("_cols"), F.lit(0))), lambda c, i: F.struct(F.concat(F.lit("extra_"), (i + 1).cast("string")).alias("key"), F.trim(c).alias("value")))
    entries = F.filter(F.concat(known, extra), lambda e: e["value"] != "")
    place = F.sha2(F.concat_ws("|", *block, F.col("row").cast("string")), 256)
    return joined.select(*block, "row", F.substring(place, 1, 32).alias("record_id"), *[of(f).alias(f"original_{f}") for f in fields], F.to_json(F.map_from_entries(F.array_distinct(entries))).alias("original_data"))


def to_text(c: Column) -> Column:
    """A number as text: whole ones without a point, NaN and null as an empty text."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(c.isNull() | F.isnan(c), "").when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
