"""Purchase invoices: fields and lines from cells or text, and saving each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import asking as A

# Labels of an invoice's fields and of the columns of its lines.
LABELS = {
    "invoice_number": ["invoiceno", "invoicenumber", "invoicenum", "billno"], "invoice_date": ["invoicedate", "date", "billdate"],
    "supplier": ["supplier", "suppliername", "vendor", "vendorname", "seller", "sellername"], "gstin": ["gstin", "suppliergstin", "vendorgstin"],
    "total": ["grandtotal", "invoicetotal", "totalamount", "netpayable"], "currency": ["currency"],
}
COLUMNS = {
    "description": ["description", "product", "productname", "item", "itemname", "particulars"], "quantity": ["qty", "quantity"],
    "unit_price": ["rate", "unitprice", "price"], "amount": ["amount", "linetotal", "total"],
}
NO_ITEMS = ["subtotal", "total", "grandtotal", "cgst", "sgst", "igst"]
# How a line of text names a field.
TEXT = {
    "invoice_number": r"(?im)^\s*(?:purchase\s+)?invoice\s*(?:no\.?|number|#)\s*[:#-]?\s*([^\n]+)",
    "invoice_date": r"(?im)^\s*(?:invoice\s+)?date\s*[:#-]\s*([^\n]+)",
    "supplier": r"(?im)^\s*(?:supplier|vendor|seller)(?:\s+name)?\s*[:#-]\s*([^\n]+)",
    "gstin": r"(?im)^\s*(?:supplier\s+)?GSTIN\s*[:#-]\s*([A-Z0-9]{15})",
    "total": r"(?im)^\s*(?:grand\s+total|invoice\s+total|total\s+amount|net\s+payable)\s*[:#-]?\s*(?:INR|Rs\.?|₹)?\s*([0-9][0-9,]*(?:\.\d{1,2})?)\s*$",
}
MOST_ROWS, MOST_COLUMNS = 10_000, 100


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def from_text(text: Column) -> Column:
    """struct of an invoice's fields as its text names them; what it does not name is empty."""
    read = {k: F.left(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), F.lit(200)) for k, p in TEXT.items()}
    read["total"] = F.replace(read["total"], F.lit(","), F.lit(""))
    read["currency"] = F.when(F.coalesce(text, F.lit("")).rlike(r"\bINR\b|₹"), "INR").otherwise("")
    return F.struct(*[v.alias(k) for k, v in read.items()])


def _label_map() -> Column:
    return F.create_map(*[F.lit(x) for k, names in LABELS.items() for n in names for x in (n, k)])


def from_cells(rows: DataFrame) -> DataFrame:
    """(file, invoice_number, invoice_date, supplier, gstin, total, currency) of sheets (file, sheet, row, cells).

    A label's value stands to its right, unless that is a label too, or below
    it in the next row if two labels or more stand side by side; the first
    value found counts.  Sheets over 10,000 rows or 100 columns are left out of
    the result and named by ``too_large``.
    """
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    r = rows.select("file", "sheet", "row", cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    r = r.withColumn("labels", F.transform("cells", lambda c: F.try_element_at(_label_map(), _key(c))))
    below = F.lag(F.when(F.size(F.array_distinct(F.array_compact("labels"))) >= 2, F.col("labels"))).over(Window.partitionBy("file", "sheet").orderBy("row"))
    r = r.withColumn("above", below)
    side = F.transform("cells", lambda c, i: F.struct(F.get("labels", i - 1).alias("field"), F.when(F.get("labels", i).isNull(), c).alias("value"), (i * 2 + 1).alias("at")))
    under = F.transform("cells", lambda c, i: F.struct(F.get("above", i).alias("field"), c.alias("value"), (i * 2).alias("at")))
    found = r.select("file", "sheet", "row", F.inline(F.filter(F.concat(F.coalesce(F.when(F.col("above").isNotNull(), under), F.array().cast("array<struct<field:string,value:string,at:int>>")), side), lambda x: x["field"].isNotNull() & x["value"].isNotNull() & (x["value"] != ""))))
    first = found.groupBy("file", "field").agg(F.min_by(F.left("value", F.lit(200)), F.struct("sheet", "row", "at")).alias("value"))
    wide = first.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    files = rows.select("file").distinct().join(too_large(rows), "file", "left_anti")
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
    return files.join(wide, "file", "left").select("file", *[(F.replace(get(k), F.lit(","), F.lit("")) if k == "total" else get(k)).alias(k) for k in LABELS])


def too_large(rows: DataFrame) -> DataFrame:
    """(file): those beyond the rows or columns of an invoice."""
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("w")).where((F.col("n") > MOST_ROWS) | (F.col("w") > MOST_COLUMNS)).select("file")


def items(rows: DataFrame) -> DataFrame:
    """(file, sheet, row, description, quantity, unit_price, amount): lines below the first row that heads a description and a figure; totals and taxes are no lines."""
    table = F.create_map(*[F.lit(x) for k, names in COLUMNS.items() for n in names for x in (n, k)])
    kinds = F.transform("cells", lambda c: F.try_element_at(table, _key(F.coalesce(c, F.lit("")))))
    heads = rows.select("file", "sheet", "row", kinds.alias("kinds")).where(F.array_contains("kinds", "description") & F.exists("kinds", lambda k: k.isin("quantity", "unit_price", "amount")))
    first = heads.groupBy("file", "sheet").agg(F.min_by(F.struct("row", "kinds"), "row").alias("h"))
    joined = rows.join(first, ["file", "sheet"]).where(F.col("row") > F.col("h.row"))
    at = lambda k: F.coalesce(F.trim(F.get("cells", (F.array_position(F.col("h.kinds"), k) - 1).cast("int"))), F.lit(""))
    read = lambda k: F.when(F.array_contains(F.col("h.kinds"), k), at(k)).otherwise("")
    return joined.select("file", "sheet", "row", *[read(k).alias(k) for k in COLUMNS]).where((F.col("description") != "") & ~_key(F.col("description")).isin(NO_ITEMS))


def checked(lines: DataFrame) -> DataFrame:
    """Lines with exact amounts, and whether quantity times price is the amount to the cent (null where one is missing)."""
    q, p, a = (A.invoice_amount(F.col(c)) for c in ("quantity", "unit_price", "amount"))
    return lines.withColumns({"quantity": q, "unit_price": p, "amount": a}).withColumn("agrees", F.abs(F.col("quantity") * F.col("unit_price") - F.col("amount")) <= F.lit(0.005))


def save(saved: DataFrame, reviewed: DataFrame, checkpoint) -> tuple[DataFrame, DataFrame]:
    """All invoices (id, source_hash, ...) after saving those a person reviewed, and (source_hash, id) of what was asked for.

    A source that is there already keeps its id, and one sent twice is saved
    once; new ids follow the largest.  What was not reviewed is refused.
    """
    from tidemark.operators.offers import numbered

    asked = reviewed.where("reviewed").drop("reviewed")
    fresh = asked.join(saved.select("source_hash"), "source_hash", "left_anti").dropDuplicates(["source_hash"])
    last = saved.agg(F.max("id")).first()[0] or 0
    new = numbered(fresh, "source_hash", "", checkpoint, width=1, start=last).withColumn("id", F.col("no").cast("long")).drop("no", "entity_id")
    now = saved.unionByName(new.select(*saved.columns))
    return now, asked.select("source_hash").distinct().join(now.select("source_hash", "id"), "source_hash")
