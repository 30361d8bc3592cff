"""Queries of the assistant and of invoices, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import asking as A
from tidemark.operators import assistant as S
from tidemark.operators import invoices as I
from tidemark.operators import records as R
from tidemark.plans.admin import shared
from tidemark.plans.catalogue import _offers, _query, _read
from tidemark.plans.cleaning import _pick
from tidemark.scratch import checkpointer

_ASKS = f"""SELECT c_custkey AS id, {_pick('c_custkey % 12', "concat('Quote for ', CAST(c_custkey AS STRING), ' beds')", "'show me red rings'", "concat(CAST(c_custkey AS STRING), ' pcs with 12.5% discount')", "'5 units'", "'purchase  order please'", "'final amount'", "'compare vendors of 7 items'", "''", "'18% off'", "'pony quoted'", "'20 Units incl GST'", "'what now'")} AS q, c_custkey % 2 = 0 AS selected FROM customer"""


@_query(f"""WITH a AS (SELECT *, lower(q) AS l FROM ({_ASKS})), b AS (SELECT *, regexp_matches(l, '\\b(quote|quotation|rfq|invoice|purchase\\s+invoice|purchase\\s+order|tax\\s+invoice|po)\\b') OR (regexp_matches(l, '\\b[0-9]+\\s*(units?|qty|quantity|pieces?|pcs?)\\b') AND regexp_matches(l, 'discount|gst|final amount|subtotal')) AS quote,
  coalesce(nullif(regexp_extract(l, '\\b([0-9]+)\\s*(?:units?|qty|quantity|pieces?|pcs?)\\b', 1), ''), nullif(regexp_extract(l, '\\b(?:for|of)\\s+([0-9]+)\\b', 1), ''))::BIGINT AS quantity, coalesce(nullif(regexp_extract(q, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), '')::DOUBLE / 100, 0) AS discount FROM a)
 SELECT id, quantity, discount, CASE WHEN quote THEN 'quotation' WHEN NOT regexp_matches(l, 'find|search|show|list|about|product|detail|alternative|inquiry|enquiry|pricing|vendor|compare|catalog') AND selected AND (quantity IS NOT NULL OR discount > 0) THEN 'quotation' ELSE 'search' END AS intent FROM b""")
def question_intents(spark, d):
    return shared(spark, d, _ASKS).select("id", A.quantity(F.col("q")).alias("quantity"), A.discount(F.col("q")).alias("discount"), A.intent(F.col("q"), F.col("selected")).alias("intent"))


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'exact_product_lookup' WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'vendor_lookup' WHEN c_custkey % 2 = 0 THEN 'vendor_product_lookup' ELSE 'product_lookup' END AS mode FROM customer""")
def query_modes(spark, d):
    k = F.col("c_custkey")
    return _read(spark, d, "customer").select("c_custkey", A.query_mode(F.lit(""), k % 5 == 0, k % 2 == 0, k % 3 == 0).alias("mode"))


_ONES, _TENS = "[" + ", ".join(f"'{x}'" for x in A.ONES) + "]", "[" + ", ".join(f"'{x}'" for x in A.TENS) + "]"


def _hundred(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN {_ONES}[({n}) + 1] ELSE trim({_TENS}[({n}) // 10 + 1] || ' ' || {_ONES}[({n}) % 10 + 1]) END"


_SAID = f"""trim(CASE WHEN n >= 10000000 THEN {_hundred('n // 10000000')} || ' Crore ' ELSE '' END || CASE WHEN n // 100000 % 100 > 0 THEN {_hundred('n // 100000 % 100')} || ' Lakh ' ELSE '' END || CASE WHEN n // 1000 % 100 > 0 THEN {_hundred('n // 1000 % 100')} || ' Thousand ' ELSE '' END
 || CASE WHEN n // 100 % 10 > 0 THEN {_hundred('n // 100 % 10')} || ' Hundred ' ELSE '' END || {_hundred('n % 100')})"""


@_query(f"WITH a AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT // 100 AS n, round(o_totalprice * 100)::BIGINT % 100 AS p FROM orders) SELECT o_orderkey, 'INR ' || CASE WHEN n = 0 THEN 'Zero' ELSE {_SAID} END || ' Rupees' || CASE WHEN p > 0 THEN ' and ' || {_hundred('p')} || ' Paise' ELSE '' END || ' only' AS said FROM a")
def amounts_in_words(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", A.amount_words(F.col("o_totalprice")).alias("said"))


@_query(f"WITH a AS (SELECT o_orderkey, o_orderkey * 98765::BIGINT % 900000000 AS n FROM orders) SELECT o_orderkey, CASE WHEN n = 0 THEN 'Zero' ELSE {_SAID} END AS said FROM a")
def numbers_in_words(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", A.words(F.col("o_orderkey") * F.lit(98765).cast("long") % 900000000).alias("said"))


_AMOUNTS = f"""SELECT p_partkey AS id, {_pick('p_partkey % 9', "'1,250.50'", "'Rs. 300'", "'12,34,567'", "'10 - 20'", "''", "'INR 1,2'", "'about 75 each'", "'-5'", "CAST(p_size AS STRING)")} AS v FROM part"""


@_query(f"""SELECT id, CASE WHEN regexp_full_match(regexp_replace(replace(v, ',', ''), '^(?i)(INR|RS\\.?|₹)\\s*', ''), '[0-9]+(\\.[0-9]+)?') THEN regexp_replace(replace(v, ',', ''), '^(?i)(INR|RS\\.?|₹)\\s*', '')::DOUBLE ELSE 0 END AS recorded,
 CASE WHEN regexp_full_match(regexp_replace(v, '^(?i)(INR|RS\\.?|₹)\\s*', ''), '[0-9]+(\\.[0-9]+)?|[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?|[0-9]{{1,2}}(,[0-9]{{2}})*,[0-9]{{3}}(\\.[0-9]+)?') THEN replace(regexp_replace(v, '^(?i)(INR|RS\\.?|₹)\\s*', ''), ',', '')::DOUBLE END AS strict,
 replace(nullif(regexp_extract(v, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ''), ',', '')::DOUBLE AS first, CASE WHEN regexp_full_match(replace(v, ',', ''), '[0-9]{{1,12}}(\\.[0-9]{{1,2}})?') THEN replace(v, ',', '')::DOUBLE END AS invoice FROM ({_AMOUNTS})""")
def amount_readers(spark, d):
    v = F.col("v")
    return shared(spark, d, _AMOUNTS).select("id", A.recorded_price(v).alias("recorded"), A.strict_amount(v).alias("strict"), A.first_number(v).alias("first"), A.invoice_amount(v).cast("double").alias("invoice"))


_OFFER_ROWS = "SELECT concat('o', CAST(p_partkey AS STRING)) AS offer_id, p_name AS product_name, p_brand AS vendor_name, concat(p_name, ' ', lower(p_type)) AS search_text, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice END AS price, p_type AS category FROM part"


@_query(f"""WITH o AS ({_OFFER_ROWS}), best AS (SELECT DISTINCT product_name FROM o WHERE product_name = 'red ring'), r AS (SELECT product_name, vendor_name, price, row_number() OVER (PARTITION BY product_name ORDER BY price, vendor_name, offer_id) AS rank FROM o JOIN best USING (product_name) WHERE price > 0)
 SELECT product_name, 1 AS place, rank, vendor_name, price FROM r WHERE rank <= 10""")
def product_offers(spark, d):
    """Offers of the one product whose name is the question."""
    return S.vendor_offers(shared(spark, d, _OFFER_ROWS), "Red Ring", most_products=1)


@_query(f"""WITH o AS ({_OFFER_ROWS}) SELECT product_name, min(price) AS best_price, max(price) AS max_price, count(*) AS vendor_count FROM o WHERE price > 0 AND (product_name LIKE 'red %' AND product_name LIKE '% ring') GROUP BY 1""")
def researched_products(spark, d):
    """The best product of a question that names it; the rest of the ranking is tested against a plain version."""
    return S.research(shared(spark, d, _OFFER_ROWS), "details red ring", most_products=1).select("product_name", "best_price", "max_price", "vendor_count")


@_query(f"SELECT product_name, min(price) AS best_price, max(price) AS max_price, count(*) AS vendor_count, arg_min(category, (price, offer_id)) AS category, list_sort(list_distinct(list(vendor_name))) AS vendors FROM ({_OFFER_ROWS}) WHERE price > 0 GROUP BY 1")
def offer_blocks(spark, d):
    return R.offer_blocks(shared(spark, d, _OFFER_ROWS), "product_name", "vendor_name", "price", "category", "offer_id")


@_query("SELECT p_name, p_brand, round(avg(l_extendedprice / l_quantity), 4) AS avg_price, round(round(avg(l_extendedprice / l_quantity), 4) - min(l_extendedprice / l_quantity), 1) AS saving_on_mean FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1, 2")
def price_means(spark, d):
    return R.price_statistics(_offers(spark, d), ["p_name", "p_brand"], "l_suppkey", "price").select("p_name", "p_brand", "avg_price", F.round("saving_on_mean", 1).alias("saving_on_mean"))


_INDEX = "SELECT p_name AS title, concat(lower(p_type), ' ', lower(p_brand)) AS text, p_partkey % 3 AS priority, p_size % 5 AS score_hint, p_brand AS vendor, p_name AS product, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS sku, CASE WHEN p_size < 25 THEN 'a.csv' ELSE 'b.csv' END AS source_file FROM part"


@_query(f"""WITH i AS (SELECT *, lower(title || ' ' || text) AS h FROM ({_INDEX})), s AS (SELECT *, CASE WHEN contains(h, 'red') THEN 4 ELSE 0 END + CASE WHEN contains(h, 'economy') THEN 4 ELSE 0 END + CASE WHEN contains(h, 'red ring') THEN 8 ELSE 0 END + CASE WHEN contains(h, 'red ring') THEN 24 ELSE 0 END
  + CASE WHEN lower(title) = 'red ring' THEN 30 ELSE 0 END + CASE WHEN contains(h, 'red') OR contains(h, 'ring') THEN 12 ELSE 0 END + priority * 5 + score_hint AS score FROM i),
 u AS (SELECT vendor, product, sku, source_file, score, priority, lower(title) AS title FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY vendor, product, sku, source_file ORDER BY score DESC, priority, lower(title)) = 1)
 SELECT * FROM u ORDER BY score DESC, priority, title, vendor, product, sku, source_file LIMIT 6""")
def ranked_index(spark, d):
    return S.rank_index(shared(spark, d, _INDEX), ["red", "economy", "red ring"], "red ring")


_RECORDED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS sku, p_brand AS company_key, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS product_name, p_brand AS company_name, CASE WHEN p_partkey % 5 = 0 THEN '10-20' ELSE concat('Rs. ', CAST(p_size AS STRING)) END AS price, CASE WHEN p_partkey % 3 = 0 THEN 'usd' WHEN p_partkey % 3 = 1 THEN ' inr ' END AS currency FROM part"


@_query(f"""SELECT 'vendor:' || id AS offer_id, coalesce(nullif(sku, ''), 'vendor:' || id) AS product_id, company_key AS vendor_id, product_name, company_name AS vendor_name, CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN 0 ELSE replace(price, 'Rs. ', '')::DOUBLE END AS price, upper(trim(coalesce(currency, ''))) AS currency
 FROM ({_RECORDED}) WHERE trim(product_name) <> ''""")
def products_as_offers(spark, d):
    return S.offer_rows(shared(spark, d, _RECORDED))


@_query("""WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ') AS w FROM part) SELECT name, (('red' = ANY(w))::INT + ('ring' = ANY(w))::INT) / len(w)::DOUBLE AS share FROM n WHERE share >= 0.5""")
def name_coverage(spark, d):
    return S.coverage(["red", "ring", "the"], _read(spark, d, "part"), "p_name", 0.5)


_SHEET = f"""SELECT concat('inv', CAST(CAST(floor(c_custkey / 10) AS INT) AS STRING)) AS file, 'S' AS sheet, c_custkey % 10 AS row, {_pick('c_custkey % 10', "concat('Invoice No:|INV-', CAST(CAST(floor(c_custkey / 10) AS INT) AS STRING), '|x')", "'Supplier|Date'", "concat('Lotus ', CAST(CAST(floor(c_custkey / 10) AS INT) AS STRING), '|2024-01-02')", "'||'", "'Item|Qty|Rate|Amount'", "concat('Bed|', CAST(c_custkey % 7 + 1 AS STRING), '|10.50|', CAST((c_custkey % 7 + 1) * 10.5 AS STRING))", "'Lamp|2|1,000|1999.00'", "'Sub Total||5|'", "concat('Grand Total|Rs|1,', CAST(100 + c_custkey % 800 AS STRING), '.00')", "concat('Net payable|', CAST(c_custkey AS STRING), ',000.25')")} AS line FROM customer"""


def _sheets(spark, d):
    return shared(spark, d, _SHEET).select("file", "sheet", "row", F.split("line", r"\|").alias("cells"))


@_query(f"""WITH s AS ({_SHEET}), f AS (SELECT DISTINCT file, replace(file, 'inv', '') AS n FROM s), r AS (SELECT file, max(row) AS last, max(CASE WHEN row = 9 THEN string_split(line, '|')[2] END) AS net FROM s GROUP BY file)
 SELECT f.file, 'INV-' || n AS invoice_number, '2024-01-02' AS invoice_date, 'Lotus ' || n AS supplier, '' AS gstin, CASE WHEN r.last >= 8 THEN 'Rs' ELSE '' END AS total, '' AS currency FROM f JOIN r USING (file)""")
def invoice_fields(spark, d):
    return I.from_cells(_sheets(spark, d))


@_query(f"""WITH s AS (SELECT file, sheet, row, string_split(line, '|') AS c FROM ({_SHEET}) WHERE row > 4), i AS (SELECT file, sheet, row, c[1] AS description, c[2] AS q, c[3] AS p, c[4] AS a FROM s WHERE c[1] NOT IN ('Sub Total', 'Grand Total', 'Net payable') OR c[1] = 'Net payable'),
 n AS (SELECT file, sheet, row, description, CASE WHEN regexp_full_match(replace(q, ',', ''), '[0-9]{{1,12}}(\\.[0-9]{{1,2}})?') THEN replace(q, ',', '')::DOUBLE END AS quantity, CASE WHEN regexp_full_match(replace(p, ',', ''), '[0-9]{{1,12}}(\\.[0-9]{{1,2}})?') THEN replace(p, ',', '')::DOUBLE END AS unit_price,
  CASE WHEN regexp_full_match(replace(a, ',', ''), '[0-9]{{1,12}}(\\.[0-9]{{1,2}})?') THEN replace(a, ',', '')::DOUBLE END AS amount FROM i) SELECT *, abs(quantity * unit_price - amount) <= 0.005 AS agrees FROM n""")
def invoice_lines(spark, d):
    got = I.checked(I.items(_sheets(spark, d)))
    return got.select("file", "sheet", "row", "description", *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "amount")], "agrees")


_BILLS = f"""SELECT c_custkey AS id, concat('Purchase Invoice No: P', CAST(c_custkey AS STRING), chr(10), 'Vendor Name - Star ', CAST(c_custkey % 9 AS STRING), chr(10), {_pick('c_custkey % 3', "'Date: 2024-05-01'", "'dated today'", "'Invoice date # 1.2.24'")}, chr(10), 'Total Amount: Rs. 12,', CAST(100 + c_custkey % 800 AS STRING), '.50', chr(10), {_pick('c_custkey % 2', "'all in INR'", "'GSTIN: 08AABCA1111A1Z5'")}) AS t FROM customer"""


@_query(f"""SELECT id, 'P' || id AS invoice_number, CASE id % 3 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '' ELSE '1.2.24' END AS invoice_date, 'Star ' || (id % 9) AS supplier, CASE WHEN id % 2 = 0 THEN '' ELSE '08AABCA1111A1Z5' END AS gstin, '12' || (100 + id % 800) || '.50' AS total, CASE WHEN id % 2 = 0 THEN 'INR' ELSE '' END AS currency FROM ({_BILLS})""")
def invoice_texts(spark, d):
    return shared(spark, d, _BILLS).select("id", I.from_text(F.col("t")).alias("f")).select("id", "f.*")


@_query("""WITH s AS (SELECT o_orderkey AS id, 'h' || o_orderkey AS source_hash FROM orders WHERE o_orderkey < 100), n AS (SELECT DISTINCT 'h' || (o_orderkey % 300) AS source_hash FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 300 % 2 = 0),
 f AS (SELECT source_hash, row_number() OVER (ORDER BY source_hash) + (SELECT max(id) FROM s) AS id FROM n WHERE source_hash NOT IN (SELECT source_hash FROM s)) SELECT n.source_hash, coalesce(s.id, f.id) AS id FROM n LEFT JOIN s USING (source_hash) LEFT JOIN f USING (source_hash)""")
def saved_invoices(spark, d):
    o = _read(spark, d, "orders")
    saved = o.where("o_orderkey < 100").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("h"), "o_orderkey").alias("source_hash"))
    asked = o.select(F.concat(F.lit("h"), F.col("o_orderkey") % 300).alias("source_hash"), ((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") % 300 % 2 == 0)).alias("reviewed"))
    return I.save(saved, asked, checkpointer(spark, "invoices"))[1]
