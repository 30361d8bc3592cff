"""Queries of product extraction, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classify as K
from tidemark.operators import products as P
from tidemark.plans.admin import shared
from tidemark.plans.catalogue import _query, _read
from tidemark.plans.cleaning import _pick

_S = "CAST({} AS STRING)"
_LIST = f"""SELECT concat('list', {_S.format('p_partkey % 20')}) AS file, CAST(floor(p_partkey / 20) AS INT) AS row, CASE WHEN floor(p_partkey / 20) = 0 THEN {_pick('p_partkey % 20 % 3', "'Item Code|Item Name|Rate|UOM|Make'", "'Product|Price (INR)|MRP|GST %|Stock'", "'Name|Pack|Cost|Discount|Category'")}
 ELSE {_pick('p_partkey % 20 % 3', "concat('C', CAST(p_partkey AS STRING), '|', p_name, '|Rs. 1,', CAST(100 + p_size AS STRING), '.50|box|', p_brand)", "concat(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END, '|₹ ', CAST(p_size AS STRING), '|', CAST(p_size + 3 AS STRING), '|12 %|', CASE WHEN p_size % 7 = 0 THEN '' ELSE 'yes' END)", "concat(p_name, '|10 x 2|', CASE WHEN p_size % 4 = 0 THEN 'on request' ELSE CAST(p_size AS STRING) END, '|5.5%|', p_type)")} END AS line FROM part"""


def _lists(spark, d):
    return shared(spark, d, _LIST).select("file", "row", F.split("line", r"\|").alias("cells"))


@_query(f"""WITH l AS (SELECT file, row, string_split(line, '|') AS c, replace(file, 'list', '')::INT % 3 AS k FROM ({_LIST}) WHERE row > 0),
 r AS (SELECT file, row, CASE k WHEN 0 THEN c[2] WHEN 1 THEN CASE WHEN c[1] <> '' THEN c[1] ELSE '12 %' END ELSE c[1] END AS product_name, CASE k WHEN 0 THEN c[1] ELSE '' END AS sku, CASE k WHEN 0 THEN c[3] WHEN 1 THEN c[2] ELSE c[3] END AS p, CASE k WHEN 0 THEN c[4] ELSE '' END AS unit, CASE k WHEN 1 THEN c[3] END AS mrp,
  CASE k WHEN 1 THEN 12 END AS gst, CASE k WHEN 2 THEN 5.5 END AS discount, CASE k WHEN 0 THEN c[5] ELSE '' END AS brand, CASE k WHEN 1 THEN c[5] ELSE '' END AS availability, CASE k WHEN 2 THEN c[5] ELSE '' END AS category, CASE k WHEN 2 THEN c[2] ELSE '' END AS pack_size FROM l)
 SELECT file, row, product_name, sku, unit, brand, availability, category, pack_size, replace(nullif(regexp_extract(p, '(-?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ''), ',', '')::DOUBLE AS price, mrp::DOUBLE AS mrp, gst::DOUBLE AS gst, discount::DOUBLE AS discount, CASE WHEN contains(p, '₹') THEN 'INR' ELSE '' END AS currency,
  CASE WHEN regexp_matches(p, '[0-9]') THEN 'price' ELSE 'catalogue' END AS record_type FROM r""")
def product_rows(spark, d):
    rows = _lists(spark, d)
    heads = rows.where("row = 0").select("file", F.col("row").alias("header_row"), F.col("cells").alias("header"), F.lit("catalogue").alias("kind"))
    got = P.product_records(rows, heads, ["file"])
    return got.select("file", "row", "product_name", "sku", "unit", "brand", "availability", "category", "pack_size", "price", "mrp", "gst", "discount", "currency", "record_type")


_TAGGED = f"""SELECT p_partkey AS id, {_pick('p_partkey % 7', "''", 'p_brand')} AS company_name, p_name AS product_name, {_pick('p_partkey % 3', "''", "concat('S', CAST(p_size % 4 AS STRING))", "'s-0'")} AS sku, {_pick('p_partkey % 5', "'₹ 1,200/-'", "'10 - 20'", "''", 'CAST(p_size % 3 AS STRING)', "'USD 50'")} AS price,
 {_pick('p_partkey % 4', "'99'", "'x'", "''", "'1,00,000'")} AS mrp, {_pick('p_partkey % 2', "'18 %'", "'5'")} AS gst, {_pick('p_partkey % 6', "'INR'", "''")} AS currency FROM part"""
_ISSUES = f"""t AS ({_TAGGED}), n AS (SELECT *, CASE price WHEN '₹ 1,200/-' THEN 1200 WHEN '10 - 20' THEN NULL WHEN '' THEN NULL WHEN 'USD 50' THEN 50 ELSE price::DOUBLE END AS pn, CASE mrp WHEN '99' THEN 99 WHEN '1,00,000' THEN 100000 END AS mn,
 CASE WHEN currency <> '' THEN currency WHEN contains(price, '₹') THEN 'INR' WHEN contains(price, 'USD') THEN 'USD' ELSE '' END AS cur FROM t),
 i AS (SELECT *, list_filter([CASE WHEN company_name = '' THEN 'company is missing' END, CASE WHEN price = '10 - 20' THEN 'price: unclear numeric value' END, CASE WHEN mrp = 'x' THEN 'mrp: unclear numeric value' END, CASE WHEN sku = '' THEN 'sku is missing' END, CASE WHEN price = '' THEN 'price is missing' END, CASE WHEN cur = '' THEN 'currency is missing' END], lambda x: x IS NOT NULL) AS issues FROM n)"""


@_query(f"WITH {_ISSUES} SELECT id, pn::DOUBLE AS price_number, mn::DOUBLE AS mrp_number, CASE WHEN gst = '5' THEN 5.0 ELSE 18.0 END::DOUBLE AS gst_number, cur AS currency, issues, CASE WHEN pn IS NOT NULL THEN 'Price recorded' WHEN price = '' THEN 'No price recorded' ELSE 'Needs review' END AS price_status FROM i")
def tagged_products(spark, d):
    return P.tagged(shared(spark, d, _TAGGED)).select("id", "price_number", "mrp_number", "gst_number", "currency", "issues", "price_status")


_KEYS = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@_query(f"""WITH {_ISSUES}, k AS (SELECT *, {_KEYS.format('company_name')} AS a, {_KEYS.format('product_name')} AS b, {_KEYS.format('sku')} AS c, {_KEYS.format('cur')} AS e FROM i), g AS (SELECT a, b, c, e, count(*) AS n, count(DISTINCT pn) AS p, count(DISTINCT mn) AS m FROM k GROUP BY ALL),
 u AS (SELECT id, unnest(issues) AS issue FROM k UNION ALL SELECT id, CASE WHEN p > 1 OR m > 1 THEN 'conflicting prices or MRP' ELSE 'possible duplicate; all rows retained' END FROM k JOIN g USING (a, b, c, e) WHERE n > 1) SELECT * FROM u""")
def open_questions(spark, d):
    frames = P.workbook_frames(P.tagged(shared(spark, d, _TAGGED)), _read(spark, d, "supplier").select("s_name"), _read(spark, d, "pages").select("url"), ["company_name", "product_name", "sku", "currency"])
    return frames["needs_review"].select("id", "issue")


@_query(f"""WITH {_ISSUES}, k AS (SELECT id, len(issues) AS n, count(*) OVER (PARTITION BY {_KEYS.format('company_name')}, {_KEYS.format('product_name')}, {_KEYS.format('sku')}, {_KEYS.format('cur')}) AS g FROM i)
 SELECT id, CASE WHEN n > 0 OR g > 1 THEN 'Needs review' ELSE 'high' END AS confidence FROM k""")
def product_confidence(spark, d):
    frames = P.workbook_frames(P.tagged(shared(spark, d, _TAGGED)), _read(spark, d, "supplier").select("s_name"), _read(spark, d, "pages").select("url"), ["company_name", "product_name", "sku", "currency"])
    return frames["products"].select("id", "confidence")


_TABLE = f"""SELECT concat('t', {_S.format('c_custkey % 30')}) AS file, CAST(floor(c_custkey / 30) AS INT) AS row, CASE CAST(floor(c_custkey / 30) AS INT) WHEN 0 THEN 'Price list of spring' WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Supplier|Product Name|MRP|Net Price|MRP' WHEN c_custkey % 3 = 1 THEN 'Firm|Town' ELSE 'Note|Rate' END WHEN 3 THEN '||'
 ELSE concat(c_mktsegment, '|', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Bed' END, '|', CAST(c_nationkey AS STRING), '|', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '77' END, '|1') END AS line FROM customer WHERE c_custkey < 600"""


@_query(f"""WITH t AS (SELECT file, row, replace(file, 't', '')::INT % 3 AS k, line, string_split(line, '|') AS c FROM ({_TABLE}) WHERE replace(line, '|', '') <> '' AND row <> 1)
 SELECT file, row, CASE WHEN row = 0 THEN 'text' WHEN k = 0 AND c[2] <> '' THEN 'product' WHEN k < 2 THEN 'company' ELSE 'row' END AS kind, CASE WHEN row = 0 OR k = 2 THEN '' ELSE c[1] END AS company, CASE WHEN row > 0 AND k = 0 THEN c[2] ELSE '' END AS product,
 CASE WHEN row = 0 THEN '' WHEN k = 0 THEN CASE WHEN c[4] <> '' THEN c[4] ELSE c[3] END WHEN k = 2 THEN c[2] ELSE '' END AS price FROM t""")
def drive_rows(spark, d):
    rows = shared(spark, d, _TABLE).select("file", "row", F.split("line", r"\|").alias("cells"))
    return P.table_rows(rows, ["file"]).select("file", "row", "kind", "company", "product", "price")


@_query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'own' WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END AS company, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE 'none' END AS price FROM part")
def record_labels(spark, d):
    k = F.col("p_partkey")
    m = F.create_map(F.when(k % 3 == 1, "Vendor Name").otherwise("Other"), F.col("p_brand"), F.lit("M.R.P"), F.when(k % 2 == 0, "999").otherwise(" "), F.lit("Net  Price"), F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise(""))
    return _read(spark, d, "part").select("p_partkey", P.catalogue_labels(m, F.when(k % 3 == 0, " own "), F.lit("none")).alias("l")).select("p_partkey", "l.company", "l.price")


@_query("SELECT o_orderkey, coalesce((SELECT max_by(l_shipdate::DATE::VARCHAR, (l_linenumber, l_shipdate::DATE::VARCHAR)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30), '') AS source_price_text FROM orders")
def recovered_prices(spark, d):
    review = _read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("h"), "o_orderkey").alias("file_hash"), F.lit("S").alias("source_sheet"), F.lit("1").alias("source_page"))
    source = _read(spark, d, "lineitem").where("l_quantity > 30").select(F.concat(F.lit("h"), "l_orderkey").alias("file_hash"), F.lit("S").alias("source_sheet"), F.lit("1").alias("source_page"), F.col("l_shipdate").cast("date").cast("string").alias("price_text"), F.col("l_linenumber").alias("row"))
    return P.price_texts(review, source).select("o_orderkey", "source_price_text")


@_query("SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def documents_to_extract(spark, d):
    return P.unextracted(_read(spark, d, "part").select(F.col("p_partkey").alias("id")), _read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("document_id")))


_GOODS = f"""SELECT p_partkey AS id, {_pick('p_partkey % 4', "'surgical gloves'", "'paracetamol tablets'", "'wooden chair'", "''")} AS product_name, CASE WHEN p_partkey % 5 = 0 THEN 'v2' WHEN p_partkey % 5 = 1 THEN 'v1' END AS policy_version FROM part"""


@_query(f"SELECT id, CASE WHEN policy_version = 'v2' THEN 'kept' WHEN product_name = 'surgical gloves' THEN 'approved' WHEN product_name = 'paracetamol tablets' THEN 'excluded' ELSE 'review' END AS catalogue_status, 'v2' AS policy_version FROM ({_GOODS})")
def reclassified_products(spark, d):
    rows = shared(spark, d, _GOODS).withColumns({"catalogue_status": F.lit("kept"), "classification_reason": F.lit("")})
    verdict = K.product_policy(F.col("product_name"), [], F.lit("catalogue"), F.lit(""), {})
    return P.reclassified(rows, verdict, "v2").select("id", "catalogue_status", "policy_version")


@_query("""SELECT p_partkey, sha256(j) AS sha256, md5(j) AS md5 FROM (SELECT p_partkey, '{"a":"' || p_brand || '","b":"' || p_name || '"}' AS j FROM part)""")
def record_hashes(spark, d):
    m = F.create_map(F.lit("b"), F.col("p_name"), F.lit("a"), F.col("p_brand"))
    h = P.identity(m)
    return _read(spark, d, "part").select("p_partkey", h["sha256"].alias("sha256"), h["md5"].alias("md5"))


@_query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS spaced, md5(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g')) AS compact, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{Nd}]+', ' ', 'g'))) AS worded FROM documents")
def three_normal_forms(spark, d):
    t = F.col("text")
    return _read(spark, d, "documents").select("doc_id", F.md5(P.spaced(t)).alias("spaced"), F.md5(P.compact(t)).alias("compact"), F.md5(P.worded(t)).alias("worded"))


_JOBS = f"SELECT o_custkey AS job, {_pick('o_orderkey % 4', chr(39) + 'done' + chr(39), chr(39) + 'skipped' + chr(39), chr(39) + 'running' + chr(39), chr(39) + 'waiting' + chr(39))} AS status, o_orderkey % 13 AS done, o_orderkey % 10 AS total FROM orders"


@_query(f"SELECT job, round(100 * avg(CASE WHEN status IN ('done', 'skipped') THEN 1.0::DOUBLE WHEN total > 0 THEN least(1.0::DOUBLE, done / total) ELSE 0 END), 1) AS percent FROM ({_JOBS}) GROUP BY job")
def job_progress(spark, d):
    return P.progress(shared(spark, d, _JOBS))


_WORDS = f"SELECT user_id % 10 AS page, user_id AS line, event_id * 10 AS x, 6 AS width, 1 + event_id % 3 AS height, value * 4 AS confidence, event_type AS word FROM events"


@_query(f"""WITH w AS ({_WORDS}), h AS (SELECT page, median(height) AS h FROM w GROUP BY page), g AS (SELECT w.*, h, lag(x + width) OVER (PARTITION BY page, line ORDER BY x) AS e FROM w JOIN h USING (page))
 SELECT page, line, string_agg(CASE WHEN e IS NULL THEN '' WHEN x - e > 1.6 * h THEN ' | ' ELSE ' ' END || word, '' ORDER BY x) AS text, round(avg(confidence), 1) AS confidence, round(avg(confidence), 1) < 60 AS low FROM g GROUP BY page, line""")
def recognised_lines(spark, d):
    return P.line_confidence(shared(spark, d, _WORDS))


@_query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'catalogue' WHEN 2 THEN 'price' END AS kind FROM part")
def file_kinds(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Rate-list.PDF").when(k == 1, "our catalogue.v2.pdf").when(k == 2, "x.pdf").otherwise("accurate.pdf")
    return _read(spark, d, "part").select("p_partkey", P.file_kind(name, F.when(k == 2, "All products with MRP").otherwise("none")).alias("kind"))
