"""Products, contacts and open questions out of price lists and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import asking as A

# Parts of headers of product tables, in the order in which fields are looked for.
PARTS = {
    "product_name": ["product", "item", "description", "particular", "name"], "sku": ["sku", "code", "model", "part no"], "price": ["price", "rate", "amount", "cost"],
    "unit": ["unit", "uom"], "mrp": ["mrp"], "discount": ["discount"], "gst": ["gst", "tax"], "brand": ["brand", "make"], "category": ["category"],
    "specification": ["specification", "spec"], "pack_size": ["pack"], "moq": ["moq", "minimum order"], "availability": ["availability", "stock"],
}
# Compact headers of companies, products and prices; a sale's price before others.
COMPANY = [
    "companyname", "company", "vendorname", "vendor", "suppliername", "supplier", "manufacturername", "manufacturer", "hospitalname", "hospital", "vendorbrand",
    "companyvendor", "supplierbrand", "firmname", "firm", "organizationname", "organisationname", "organization", "organisation",
]
PRODUCT = ["productname", "product", "itemname", "item", "description", "particulars", "productdescription"]
PRICES = [
    "salesprice", "sellingprice", "netprice", "offerprice", "dealerprice", "price", "unitprice", "rate", "netrate", "dealerrate", "salerate", "regularprice", "mrp",
    "maximumretailprice", "amount",
]
LIMITS = {"product_name": 500, "sku": 200, "unit": 100, "brand": 200, "category": 200, "specification": 2000, "pack_size": 200, "moq": 100, "availability": 100}


def compact(c: Column) -> Column:
    """Letters and digits of a header, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]", "")


def spaced(c: Column) -> Column:
    """ASCII letters and digits, lower-cased, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def worded(c: Column) -> Column:
    """Word characters of any script, lower-cased, with single blanks; underscores are blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[\W_]+", " "))


def file_kind(name: Column, text: Column) -> Column:
    """``price`` or ``catalogue`` by a file's name and text, else null."""
    x = F.lower(F.concat_ws(" ", F.regexp_replace(name, r"\.[^./]*$", ""), text))
    return F.when(x.rlike(r"\b(?:price|pricing|rate|mrp|amount|cost)\b"), "price").when(x.rlike(r"\b(?:catalogue|catalog|product list|product)\b"), "catalogue")


def column_of(headers: Column, field: str) -> Column:
    """0-based place of the column that holds a field: the first whose header has one of its parts; null if none.

    A product's name is looked for by its fuller headers first, and never under a code.
    """
    at = lambda test: F.nullif(F.coalesce(F.array_position(F.transform(headers, test), True), F.lit(0)), F.lit(0)) - 1
    any_part = lambda h: F.lower(h).rlike("|".join(PARTS[field]))
    if field != "product_name":
        return at(any_part)
    full = lambda h: h.rlike(r"(?i)\b(?:product|item)\s*(?:name|description)\b|\b(?:description|particular)\b")
    plain = lambda h: h.rlike(r"(?i)\b(?:product|item)\b") & ~h.rlike(r"(?i)\b(?:code|sku|model)\b")
    return F.coalesce(at(full), at(plain), at(any_part))


def product_records(rows: DataFrame, headers: DataFrame, block: list[str], kind: str = "kind") -> DataFrame:
    """Products of rows (row, cells) under their block's ``header`` (header_row, header, kind).

    A row without a product's name takes its first filled cell that is no
    price; rows with neither are left out.  A catalogue's row with a price is a
    price row.
    """
    j = rows.join(headers, block).where(F.col("row") > F.col("header_row"))
    places = {f: column_of(F.col("header"), f) for f in PARTS}
    cell = lambda i: F.trim(F.coalesce(F.get("cells", i.cast("int")), F.lit("")))
    read = lambda f: F.when(places[f].isNotNull(), cell(places[f])).otherwise("")
    pairs = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("key"), cell(i).alias("value"))), lambda p: p["value"] != "")
    other = F.get(F.filter(pairs, lambda p: ~p["key"].rlike("(?i)price|rate|amount|cost|mrp")), F.lit(0))["value"]
    j = j.select(*block, "row", kind, pairs.alias("_pairs"), other.alias("_other"), *[read(f).alias(f) for f in PARTS])
    j = j.withColumn("product_name", F.coalesce(F.nullif("product_name", F.lit("")), "_other")).where(F.coalesce("product_name", F.lit("")) != "")
    number = lambda c, sign="-?": F.replace(F.nullif(F.regexp_extract(c, rf"({sign}\d[\d,]*(?:\.\d+)?)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    raw = F.col("price")
    return j.select(
        *block, "row", F.when((F.col(kind) == "catalogue") & number(raw).isNotNull(), "price").otherwise(F.col(kind)).alias("record_type"), *[F.left(f, F.lit(n)).alias(f) for f, n in LIMITS.items()],
        number(raw).alias("price"), number(F.col("mrp")).alias("mrp"), number(F.col("discount"), "").alias("discount"), number(F.col("gst"), "").alias("gst"),
        F.when(F.lower(raw).rlike("₹|inr"), "INR").otherwise("").alias("currency"), F.left(F.to_json(F.map_from_entries(F.array_distinct(F.col("_pairs")))), F.lit(8000)).alias("description"))


def tagged(products: DataFrame, company: str = "company_name") -> DataFrame:
    """Product rows with their prices read strictly, and ``issues``: what a person has to look at."""
    read = lambda c: A.strict_amount(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"/-\s*$", ""), r"(?i)^\s*(?:usd|eur|gbp|\$|€|£)\s*", ""))
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    percent = A.strict_amount(F.regexp_replace(F.col("gst").cast("string"), r"\s*%\s*$", ""))
    currency = F.coalesce(F.nullif(F.trim("currency"), F.lit("")), *[F.when(F.col("price").cast("string").rlike(p), c) for p, c in ((r"(?i)₹|\bINR\b|\bRs\.?", "INR"), (r"(?i)\bUSD\b", "USD"), (r"(?i)€|\bEUR\b", "EUR"), (r"(?i)£|\bGBP\b", "GBP"))], F.lit(""))
    unclear = lambda c, value: F.when(~blank(c) & value.isNull(), f"{c}: unclear numeric value")
    issues = F.array_compact(F.array(
        F.when(blank(company), "company is missing"), unclear("price", read("price")), unclear("mrp", read("mrp")), unclear("gst", percent),
        F.when(blank("sku"), "sku is missing"), F.when(blank("price"), "price is missing"), F.when(currency == "", "currency is missing")))
    return products.withColumns({
        "issues": issues, "price_number": read("price"), "mrp_number": read("mrp"), "gst_number": percent, "currency": currency,
        "price_status": F.when(read("price").isNotNull(), "Price recorded").when(blank("price"), "No price recorded").otherwise("Needs review")})


def workbook_frames(products: DataFrame, contacts: DataFrame, files: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """The frames of a product workbook: products, contacts, needs_review and files.

    ``products`` come from ``tagged``.  Rows of one ``key`` (compared by letters
    and digits) are a conflict if their prices or MRPs differ, else possible
    duplicates; all stay, and both are open questions.
    """
    k = [spaced(F.col(c)).alias(f"_k{i}") for i, c in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    keyed = products.select("*", *k)
    groups = keyed.groupBy(*names).agg(F.count("*").alias("_n"), F.count_distinct("price_number").alias("_p"), F.count_distinct("mrp_number").alias("_m")).where("_n > 1")
    said = F.when((F.col("_p") > 1) | (F.col("_m") > 1), "conflicting prices or MRP").when(F.col("_n").isNotNull(), "possible duplicate; all rows retained")
    joined = keyed.join(groups, names, "left").withColumn("issues", F.array_compact(F.concat("issues", F.array(said)))).drop(*names, "_n", "_p", "_m")
    final = joined.withColumn("review_flag", F.when(F.size("issues") > 0, "Needs review").otherwise("")).withColumn("confidence", F.when(F.size("issues") > 0, "Needs review").otherwise("high"))
    review = final.select(*[c for c in products.columns if c != "issues"], F.explode("issues").alias("issue"))
    order = [F.lower(F.col(c).cast("string")) for c in key[:3]]
    return {"products": final.drop("issues").orderBy(*order), "contacts": contacts.dropDuplicates().orderBy(F.lower(contacts.columns[0])), "needs_review": review, "files": files.orderBy(F.lower(files.columns[0]))}


def table_rows(rows: DataFrame, block: list[str], fallback: str = "") -> DataFrame:
    """Rows (row, cells) of drive tables: kind, company, product, price and values by header.

    The first row with a header of a company, product or price heads its table;
    rows before it are text.
    """
    known = [*COMPANY, *PRODUCT, *PRICES]
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    r = rows.select(*block, "row", cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    heads = r.where(F.exists("cells", lambda c: compact(c).isin(known))).groupBy(*block).agg(F.min_by(F.struct("row", "cells"), "row").alias("h"))
    named = F.transform(F.col("h.cells"), lambda c, i: F.concat(F.when(c == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(c), F.when((i > 0) & F.array_contains(F.slice(F.col("h.cells"), 1, i), c), F.concat(F.lit(" ["), (i + 1).cast("string"), F.lit("]"))).otherwise("")))
    j = r.join(heads, block, "left").where(F.col("h.row").isNull() | (F.col("row") != F.col("h.row")))
    below = F.col("h.row").isNotNull() & (F.col("row") > F.col("h.row"))
    values = F.filter(F.transform("cells", lambda c, i: F.struct(F.coalesce(F.get(named, i), F.concat(F.lit("Column "), (i + 1).cast("string"))).alias("key"), c.alias("value"))), lambda v: v["value"] != "")
    j = j.select(*block, "row", below.alias("_b"), F.when(below, values).alias("values"), F.array_join(F.filter("cells", lambda c: c != ""), " | ").alias("text"))
    first = lambda names: F.get(F.filter("values", lambda v: compact(v["key"]).isin(names)), F.lit(0))["value"]
    ranked = F.coalesce(*[first([p]) for p in PRICES], F.lit(""))
    company, product = F.coalesce(first(COMPANY), F.lit(fallback)), F.coalesce(first(PRODUCT), F.lit(""))
    return j.select(
        *block, "row", F.when(~F.col("_b"), "text").when(product != "", "product").when(company != "", "company").otherwise("row").alias("kind"), company.alias("company"),
        product.alias("product"), F.when(F.col("_b"), ranked).otherwise("").alias("price"), "text", F.to_json(F.map_from_entries("values")).alias("record"))


def catalogue_labels(record: Column, company: Column, price: Column) -> Column:
    """struct(company, price) of a record's map: its own company, else the first of the known headers; the sale's price before others."""
    entries = F.transform(F.map_entries(record), lambda e: F.struct(compact(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    find = lambda k: F.get(F.filter(entries, lambda e: (e["key"] == k) & (e["value"] != "")), F.lit(0))["value"]
    own = F.nullif(F.trim(F.coalesce(company, F.lit(""))), F.lit(""))
    return F.struct(F.coalesce(own, *[find(k) for k in COMPANY], F.lit("")).alias("company"), F.coalesce(*[find(k) for k in PRICES], F.trim(F.coalesce(price, F.lit("")))).alias("price"))


def price_texts(review: DataFrame, source: DataFrame) -> DataFrame:
    """Review rows (file_hash, source_sheet, source_page) with the price's text as their source has it; empty where it has none."""
    key = ["file_hash", "source_sheet", "source_page"]
    s = source.groupBy(*key).agg(F.max_by("price_text", F.struct("row", "price_text")).alias("source_price_text"))
    return review.join(s, key, "left").withColumn("source_price_text", F.coalesce("source_price_text", F.lit("")))


def unextracted(documents: DataFrame, products: DataFrame) -> DataFrame:
    """Documents (id) of which no product (document_id) is known yet."""
    return documents.join(products.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def reclassified(products: DataFrame, verdict: Column, version: str) -> DataFrame:
    """All products with the status and reason of a policy (struct status, reason); those that this version has seen stay as they are."""
    old = F.coalesce(F.col("policy_version"), F.lit("")) == version
    return products.withColumn("_v", verdict).withColumns({
        "catalogue_status": F.when(old, F.col("catalogue_status")).otherwise(F.col("_v.status")), "classification_reason": F.when(old, F.col("classification_reason")).otherwise(F.col("_v.reason")),
        "policy_version": F.lit(version)}).drop("_v")


def identity(record: Column) -> dict[str, Column]:
    """Hashes of a record's map whatever the order of its keys: sha256, sha1 and md5 of its JSON."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record))))
    return {"sha256": F.sha2(text, 256), "sha1": F.sha1(text), "md5": F.md5(text)}


def progress(stages: DataFrame) -> DataFrame:
    """(job, percent) of stages (job, status, done, total): the mean of their shares; done and skipped ones count whole."""
    share = F.when(F.col("status").isin("done", "skipped"), 1.0).when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(0.0)
    return stages.groupBy("job").agg(F.round(100 * F.avg(share), 1).alias("percent"))


def line_confidence(words: DataFrame, gap: float = 1.6) -> DataFrame:
    """Lines (page, line) of words (x, width, height, confidence, word): text with `` | `` at wide gaps, mean confidence, and whether it is below 60.

    A gap is wide beyond ``gap`` times the median height of the page's words.
    """
    height = words.groupBy("page").agg(F.median("height").alias("_h"))
    w = Window.partitionBy("page", "line").orderBy("x")
    end = F.lag(F.col("x") + F.col("width")).over(w)
    marked = words.join(F.broadcast(height), "page").withColumn("_gap", F.when(end.isNull(), "").when(F.col("x") - end > gap * F.col("_h"), " | ").otherwise(" "))
    return marked.groupBy("page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.concat("_gap", "word").alias("t")))), lambda t: t["t"]), "").alias("text"), F.round(F.avg("confidence"), 1).alias("confidence")).withColumn("low", F.col("confidence") < 60)
