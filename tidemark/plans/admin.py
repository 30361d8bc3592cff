"""Queries of exports, reports, searches and companies, each beside its SQL.

Source tables are made by one SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import companies as C
from tidemark.operators import exports as X
from tidemark.operators import finding as S
from tidemark.operators import records as R
from tidemark.plans.catalogue import _query, _read
from tidemark.plans.cleaning import _pick

_TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|pages"


def shared(spark, d, sql: str):
    """The rows of an SQL text over the tables of ``d``."""
    for t in set(re.findall(rf"\b(?:FROM|JOIN) ({_TABLES})\b", sql)):
        _read(spark, d, t).createOrReplaceTempView(f"_tidemark_{t}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({_TABLES})\b", r"\1 _tidemark_\2", sql))


_N = "CAST({} AS STRING)"
ENTITIES = f"""SELECT s_suppkey AS entity_id, s_name AS standard_name, {_pick('s_nationkey % 5', "'Rajasthan'", "'Haryana'", "''", "'Delhi'", "'Goa'")} AS state, {_pick('s_suppkey % 4', "'Kota'", "'Jaipur'", "''", "'Ambala'")} AS city,
 {_pick('s_suppkey % 3', "'verified'", "'auto'", "'needs_review'")} AS status, s_acctbal AS confidence, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey + 1 END AS merged_into, concat('08', {_N.format('s_suppkey')}) AS registration_id FROM supplier"""
RAWS = f"""SELECT c_custkey AS seq, concat('r', {_N.format('c_custkey')}) AS record_id, concat('file', {_N.format('c_custkey % 12')}, '.csv') AS source_file, CASE WHEN c_custkey % 3 = 0 THEN 'Sheet1' END AS source_sheet,
 c_name AS original_name, c_custkey % 10 <> 0 AS is_current FROM customer"""
CLEANED = f"""SELECT concat('r', {_N.format('c_custkey')}) AS record_id, lower(c_name) AS name_normalized, {_pick('c_custkey % 7', "'error'", "'warning'", "'ok'")} AS quality_severity, c_custkey % 11 <> 0 AS is_resolvable FROM customer WHERE c_custkey % 8 <> 0"""
RESOLUTIONS = f"""SELECT concat('r', {_N.format('c_custkey')}) AS record_id, c_custkey % 40 AS entity_id, c_acctbal AS match_score, {_pick('c_custkey % 4', "'auto_matched'", "'verified_mapping'", "'needs_review'", "'new_entity'")} AS match_status,
 c_custkey % 4 = 1 AS verified_by_user, {_pick('c_custkey % 3', "'High'", "''", "'Very High'")} AS match_band FROM customer WHERE c_custkey % 5 <> 0"""
ALIASES = f"""SELECT p_partkey % 60 AS entity_id, concat(p_name, ' ', {_N.format('p_partkey')}) AS alias, p_size AS occurrences, p_partkey % 2 = 0 AS verified FROM part"""
GROUPS = f"""SELECT concat('DP-', {_N.format('c_custkey % 50')}) AS group_id, 'exact_name_phone' AS dup_type, concat('r', {_N.format('c_custkey')}) AS record_id, c_custkey % 70 AS entity_id, c_custkey < 50 AS is_primary FROM customer WHERE c_custkey % 3 = 0"""
REVIEWS = f"""SELECT o_orderkey AS review_id, o_custkey % 90 AS candidate_id, {_pick('o_orderkey % 3', "'pending'", "'accepted'", "'rejected'")} AS status, o_custkey AS record_count, o_totalprice AS match_score FROM orders"""
ISSUES = f"""SELECT concat('r', {_N.format('user_id')}) AS record_id, event_type AS issue_type, {_pick('event_id % 4', "'error'", "'warning'", "'info'", "'warning'")} AS severity, concat(event_type, ' seen') AS message FROM events"""
ERRORS = """SELECT ts AS occurred_at, concat('file', CAST(user_id AS STRING)) AS file_name, event_type AS stage, CASE WHEN value > 20 THEN 'error' ELSE 'warning' END AS severity, props AS message FROM events WHERE value > 15"""
FILES = f"""SELECT concat('/in/', {_N.format('page_id')}, '.csv') AS source_path, {_pick('page_id % 5', "'processed'", "'failed'", "'unsupported'", "'duplicate_file'", "'processed'")} AS status,
 CASE WHEN page_id % 3 = 0 THEN concat('{{"blocks":[{{"sheet":"S', {_N.format('page_id % 4')}, '","header_row":2,"columns":[{{"original":"Town","field":"city","method":"exact","confidence":1.0}},{{"original":"X","field":null,"method":"none","confidence":0.0}}]}},{{"sheet":"","page":7,"columns":[{{"original":"Nm","field":"name","method":"fuzzy","confidence":0.85}}]}}]}}') END AS inspection FROM pages"""


@_query(f"SELECT entity_id, standard_name, state, city, CASE status WHEN 'auto' THEN 'Automatic' WHEN 'verified' THEN 'Verified' ELSE 'Needs review' END AS status, confidence, registration_id FROM ({ENTITIES}) WHERE merged_into IS NULL")
def export_master_data(spark, d):
    return X.master_data(shared(spark, d, ENTITIES))


@_query(f"""SELECT r.record_id, r.source_file, coalesce(r.source_sheet, '') AS sheet, r.original_name, c.name_normalized, e.standard_name, m.entity_id, m.match_score, m.match_status, c.quality_severity, e.state, e.city
 FROM ({RAWS}) r LEFT JOIN ({CLEANED}) c USING (record_id) LEFT JOIN ({RESOLUTIONS}) m USING (record_id) LEFT JOIN ({ENTITIES}) e ON e.entity_id = m.entity_id WHERE r.is_current""")
def export_name_mapping(spark, d):
    return X.name_mapping(shared(spark, d, RAWS), shared(spark, d, CLEANED), shared(spark, d, RESOLUTIONS).select("record_id", "entity_id", "match_score", "match_status"), shared(spark, d, ENTITIES))


@_query(f"SELECT e.standard_name, a.alias, a.entity_id, a.occurrences, a.verified FROM ({ALIASES}) a JOIN ({ENTITIES}) e ON e.entity_id = a.entity_id WHERE e.merged_into IS NULL")
def export_aliases(spark, d):
    return X.alias_list(shared(spark, d, ALIASES), shared(spark, d, ENTITIES))


@_query(f"SELECT g.*, r.source_file, r.original_name, e.standard_name FROM ({GROUPS}) g LEFT JOIN ({RAWS}) r USING (record_id) LEFT JOIN ({ENTITIES}) e ON e.entity_id = g.entity_id")
def export_duplicates(spark, d):
    return X.duplicate_list(shared(spark, d, GROUPS), shared(spark, d, RAWS), shared(spark, d, ENTITIES))


@_query(f"SELECT v.*, e.standard_name AS candidate_name FROM ({REVIEWS}) v LEFT JOIN ({ENTITIES}) e ON e.entity_id = v.candidate_id WHERE v.status = 'pending'")
def export_reviews(spark, d):
    return X.review_list(shared(spark, d, REVIEWS), shared(spark, d, ENTITIES))


@_query(f"""SELECT r.record_id, r.source_file, r.original_name, c.quality_severity, string_agg(DISTINCT i.message, ' | ' ORDER BY i.message) AS problem FROM ({CLEANED}) c JOIN ({RAWS}) r USING (record_id) LEFT JOIN ({ISSUES}) i USING (record_id)
 WHERE r.is_current AND (c.quality_severity = 'error' OR NOT c.is_resolvable) GROUP BY ALL""")
def export_invalid_records(spark, d):
    return X.invalid_records(shared(spark, d, RAWS), shared(spark, d, CLEANED), shared(spark, d, ISSUES))


@_query(f"SELECT i.*, r.source_file, r.original_name FROM ({ISSUES}) i LEFT JOIN ({RAWS}) r USING (record_id)")
def export_quality(spark, d):
    return X.quality_list(shared(spark, d, ISSUES), shared(spark, d, RAWS))


@_query(f"SELECT strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, file_name, stage, severity, message FROM ({ERRORS})")
def export_errors(spark, d):
    return X.error_list(shared(spark, d, ERRORS)).withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))


_METRICS = {
    "Files found": f"SELECT count(*) FROM ({FILES})", **{k: f"SELECT count(*) FROM ({FILES}) WHERE status = '{s}'" for k, s in (("Files processed", "processed"), ("Files failed", "failed"), ("Files unsupported", "unsupported"), ("Duplicate files skipped", "duplicate_file"))},
    "Records extracted": f"SELECT count(*) FROM ({RAWS}) WHERE is_current", "Records with a name": f"SELECT count(*) FROM ({RAWS}) r JOIN ({CLEANED}) c USING (record_id) WHERE r.is_current AND c.is_resolvable",
    "Master entities": f"SELECT count(*) FROM ({ENTITIES}) WHERE merged_into IS NULL", "Auto-matched records": f"SELECT count(*) FROM ({RESOLUTIONS}) WHERE match_status IN ('auto_matched', 'verified_mapping')",
    "Records confirmed by user": f"SELECT count(*) FROM ({RESOLUTIONS}) WHERE verified_by_user", "Pending manual reviews": f"SELECT count(*) FROM ({REVIEWS}) WHERE status = 'pending'", "Duplicate groups": f"SELECT count(DISTINCT group_id) FROM ({GROUPS})",
    "Data-quality issues": f"SELECT count(*) FROM ({ISSUES})", "Processing errors": f"SELECT count(*) FROM ({ERRORS}) WHERE severity = 'error'",
}


@_query(" UNION ALL ".join(f"SELECT '{k}' AS metric, ({q})::VARCHAR AS value" for k, q in _METRICS.items()) + " UNION ALL SELECT 'Generated at', '2024-01-01 00:00:00'")
def report_summary(spark, d):
    t = [shared(spark, d, s) for s in (FILES, RAWS, CLEANED, ENTITIES, RESOLUTIONS, REVIEWS, GROUPS, ISSUES, ERRORS)]
    return X.report_metrics(*t, now="2024-01-01 00:00:00")


@_query(f"""WITH b AS (SELECT source_path AS file, unnest(from_json(inspection, '{{"blocks":[{{"sheet":"VARCHAR","page":"INTEGER","header_row":"INTEGER","columns":[{{"original":"VARCHAR","field":"VARCHAR","method":"VARCHAR","confidence":"DOUBLE"}}]}}]}}').blocks) AS b FROM ({FILES}) WHERE inspection IS NOT NULL),
 c AS (SELECT file, coalesce(nullif(b.sheet, ''), 'page ' || b.page, '') AS block, b.header_row AS header_row, unnest(b.columns) AS c FROM b) SELECT file, block, header_row, c.original AS original, coalesce(c.field, '(kept, not mapped)') AS mapped_to, c.method AS method, c.confidence AS confidence FROM c""")
def report_columns(spark, d):
    return X.column_report(shared(spark, d, FILES))


@_query(f"SELECT coalesce(nullif(match_band, ''), '-') AS match_band, match_status, count(*) AS n FROM ({RESOLUTIONS}) GROUP BY 1, 2")
def report_bands(spark, d):
    return X.top_counts(shared(spark, d, RESOLUTIONS), ["match_band", "match_status"])


@_query(f"SELECT issue_type, severity, count(*) AS n FROM ({ISSUES}) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def report_issues(spark, d):
    return X.top_counts(shared(spark, d, ISSUES), ["issue_type", "severity"], 10)


@_query(f"SELECT coalesce(nullif(state, ''), 'Unknown') AS state, count(*) AS n FROM ({ENTITIES}) WHERE merged_into IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def entities_by_state(spark, d):
    return X.top_counts(shared(spark, d, ENTITIES).where("merged_into is null"), ["state"], 12, "Unknown")


@_query("""WITH b AS (SELECT DISTINCT p_type || ' / ' || p_name AS name FROM part), s AS (SELECT name, left(trim(regexp_replace(name, '[\\[\\]:*?/\\\\'']', ' ', 'g')), 12) AS base FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY name) AS n FROM s)
 SELECT name, CASE WHEN n = 1 THEN base ELSE left(base, 12 - length(' ' || n)) || ' ' || n END AS sheet FROM n""")
def workbook_sheets(spark, d):
    names = _read(spark, d, "part").select(F.concat_ws(" / ", "p_type", "p_name").alias("name")).distinct()
    return X.sheet_names(names, "name", 12)


@_query(f"""SELECT entity_id, standard_name, state FROM ({ENTITIES}) WHERE merged_into IS NULL AND (lower(standard_name) LIKE '%supplier#0000000%' OR lower(registration_id) LIKE '%supplier#0000000%') AND lower(state) = 'haryana'""")
def entity_search(spark, d):
    return S.search(shared(spark, d, ENTITIES).where("merged_into is null"), ["standard_name", "registration_id"], " Supplier#0000000", {"state": "HARYANA", "city": ""}).select("entity_id", "standard_name", "state")


@_query(f"""SELECT entity_id, standard_name FROM ({ENTITIES}) WHERE merged_into IS NULL ORDER BY confidence DESC, entity_id LIMIT 25 OFFSET 10""")
def entity_pages(spark, d):
    return S.sorted_page(shared(spark, d, ENTITIES).where("merged_into is null"), "confidence", ["standard_name", "confidence"], "entity_id", True, 25, 10).select("entity_id", "standard_name")


@_query(f"""SELECT r.record_id, r.original_name, e.standard_name FROM ({RAWS}) r LEFT JOIN ({RESOLUTIONS}) m USING (record_id) LEFT JOIN ({ENTITIES}) e ON e.entity_id = m.entity_id
 WHERE r.is_current AND (lower(r.original_name) LIKE '%00007%' OR lower(e.standard_name) LIKE '%00007%') AND m.match_status = 'auto_matched'""")
def record_search(spark, d):
    rows = shared(spark, d, RAWS).where("is_current").join(shared(spark, d, RESOLUTIONS), "record_id", "left").join(shared(spark, d, ENTITIES).select("entity_id", "standard_name"), "entity_id", "left")
    return S.search(rows, ["original_name", "standard_name"], "00007", {"match_status": "auto_matched"}).select("record_id", "original_name", "standard_name")


@_query(f"SELECT review_id, match_score FROM ({REVIEWS}) WHERE status = 'pending' ORDER BY record_count DESC, review_id LIMIT 100")
def review_search(spark, d):
    return S.sorted_page(S.search(shared(spark, d, REVIEWS), [], "", {"status": "pending"}), "record_count", ["record_count"], "review_id", True, 100).select("review_id", "match_score")


@_query(f"""SELECT record_id, issue_type, severity FROM ({ISSUES}) WHERE severity = 'warning' AND issue_type = 'click'""")
def issue_search(spark, d):
    return S.search(shared(spark, d, ISSUES), [], "", {"severity": "warning", "issue_type": "click"}).select("record_id", "issue_type", "severity")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def keyset_page(spark, d):
    return S.after(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 200)


_PRODUCTS = "SELECT p_partkey AS id, p_name AS product_name, CASE WHEN p_partkey % 3 = 0 THEN concat('SKU_', CAST(p_partkey AS STRING)) ELSE '' END AS sku, concat('100% ', p_type) AS description, p_brand AS company_name, CASE WHEN p_size % 3 = 0 THEN 'review' ELSE 'approved' END AS catalogue_status, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS price FROM part"


@_query(f"SELECT id, product_name FROM ({_PRODUCTS}) WHERE contains(lower(product_name), 'red') OR contains(lower(sku), 'red') OR contains(lower(description), 'red') OR contains(lower(company_name), 'red')")
def product_search(spark, d):
    return S.search(shared(spark, d, _PRODUCTS), ["product_name", "sku", "description", "company_name"], " RED ").select("id", "product_name")


@_query(f"SELECT id FROM ({_PRODUCTS}) WHERE contains(lower(sku), 'sku_1') OR contains(lower(description), 'sku_1')")
def literal_search(spark, d):
    """Marks that patterns use are text here."""
    return S.search(shared(spark, d, _PRODUCTS), ["sku", "description"], "sku_1").select("id")


@_query(f"SELECT id, company_name FROM ({_PRODUCTS}) WHERE catalogue_status = 'approved' ORDER BY lower(company_name), lower(product_name), price IS NULL, price, lower(sku), id LIMIT 100 OFFSET 100")
def published_page(spark, d):
    rows = S.by_status(shared(spark, d, _PRODUCTS), "approved")
    return rows.orderBy(F.lower("company_name"), F.lower("product_name"), F.col("price").isNull(), "price", F.lower("sku"), "id").offset(100).limit(100).select("id", "company_name")


_CHECK = "SELECT c_custkey AS id, c_name AS name, c_custkey % 4 AS missing, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS needs_review FROM customer"


@_query(f"SELECT id, 'missing' AS shown FROM ({_CHECK}) WHERE missing > 0 AND contains(lower(name), '#00000001') UNION ALL SELECT id, 'complete' FROM ({_CHECK}) WHERE missing = 0 UNION ALL SELECT id, 'review' FROM ({_CHECK}) WHERE needs_review > 0")
def checklist_filters(spark, d):
    rows = shared(spark, d, _CHECK)
    parts = [S.checklist_rows(rows, "name", "#00000001", "missing"), S.checklist_rows(rows, "name", "", "complete"), S.checklist_rows(rows, "name", "", "review")]
    return parts[0].select("id", F.lit("missing").alias("shown")).unionByName(parts[1].select("id", F.lit("complete").alias("shown"))).unionByName(parts[2].select("id", F.lit("review").alias("shown")))


@_query("SELECT c_custkey, 'gst' AS category FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey % 3 = 2")
def category_filter(spark, d):
    kinds = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("gst"), F.lit("pan"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("pan"))).when(F.col("c_custkey") % 2 == 0, F.array().cast("array<string>"))
    rows = _read(spark, d, "customer").select("c_custkey", kinds.alias("types"))
    return S.of_category(rows, "types", "gst").select("c_custkey", F.lit("gst").alias("category")).unionByName(S.of_category(rows, "types", "none").select("c_custkey", F.lit("none").alias("category")))


_CAND = "SELECT c_mktsegment AS alias, CASE WHEN c_custkey % 2 = 0 THEN 'kota' ELSE '' END AS city, c_nationkey AS entity, c_custkey AS id FROM customer"
_REJ = "SELECT DISTINCT c_mktsegment AS alias, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'kota' END AS city, c_nationkey AS entity FROM customer WHERE c_custkey % 5 = 0"


@_query(f"SELECT c.* FROM ({_CAND}) c WHERE NOT EXISTS (SELECT 1 FROM ({_REJ}) r WHERE r.alias = c.alias AND r.entity = c.entity AND (r.city = '' OR r.city = c.city))")
def rejected_pairs(spark, d):
    return S.without_rejected(shared(spark, d, _CAND), shared(spark, d, _REJ))


_DRIVE = f"SELECT concat('k', {_N.format('o_orderkey')}) AS record_key, concat(o_orderpriority, {_N.format('o_custkey % 50')}) AS identity, o_custkey AS entry_key, CASE WHEN o_orderstatus = 'F' THEN 'product' ELSE 'row' END AS kind, lower(concat(o_orderpriority, ' ', o_orderstatus)) AS search_text FROM orders"
_ENTRIES = "SELECT c_custkey AS entry_key, CASE WHEN c_custkey % 4 = 0 THEN 'deleted' WHEN c_custkey % 4 = 1 THEN 'failed' WHEN c_custkey % 4 = 2 THEN 'pending' ELSE 'reading' END AS status, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS member_path, c_nationkey AS drive_id, CAST(floor(c_acctbal) AS INT) AS size_bytes FROM customer"


@_query(f"SELECT identity, min(record_key) AS record_key, count(*) AS copies FROM ({_DRIVE}) r LEFT JOIN ({_ENTRIES}) e USING (entry_key) WHERE coalesce(e.status, '') <> 'deleted' AND contains(search_text, 'urgent') AND kind = 'product' GROUP BY identity ORDER BY record_key LIMIT 40 OFFSET 5")
def drive_search(spark, d):
    return S.drive_search(shared(spark, d, _DRIVE), shared(spark, d, _ENTRIES), "URGENT", "product", 40, 5)


@_query(f"SELECT entry_key FROM ({_ENTRIES}) WHERE status <> 'deleted' ORDER BY CASE WHEN status = 'failed' THEN 1 ELSE 0 END, CASE WHEN member_path = '' THEN 1 ELSE 0 END, drive_id, size_bytes, entry_key LIMIT 500")
def work_queue(spark, d):
    return S.work_queue(shared(spark, d, _ENTRIES)).limit(500).select("entry_key")


_OLD = "SELECT p_partkey AS k, p_name AS a, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS b, p_type AS scope FROM part WHERE p_partkey % 3 <> 0"
_NEW = "SELECT p_partkey AS k, concat(p_name, ' new') AS a, concat(p_brand, ' new') AS b, concat(p_type, CASE WHEN p_size < 10 THEN '' ELSE 'x' END) AS scope FROM part WHERE p_partkey % 2 = 0"


def _both(sql: str) -> str:
    return f"WITH o AS ({_OLD}), n AS ({_NEW}) {sql}"


@_query(_both("SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k)"))
def upsert_replace(spark, d):
    return R.upsert(shared(spark, d, _OLD), shared(spark, d, _NEW), ["k"])


@_query(_both("SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.k = o.k)"))
def upsert_ignore(spark, d):
    return R.insert_new(shared(spark, d, _OLD), shared(spark, d, _NEW), ["k"])


@_query(_both("SELECT o.k, o.a, CASE WHEN n.k IS NULL THEN o.b ELSE n.b END AS b, o.scope FROM o LEFT JOIN n USING (k) UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.k = o.k)"))
def upsert_update(spark, d):
    return R.update_on_conflict(shared(spark, d, _OLD), shared(spark, d, _NEW), ["k"], ["b"])


@_query(_both("SELECT * FROM n UNION ALL SELECT * FROM o WHERE scope NOT IN (SELECT scope FROM n)"))
def replace_scopes(spark, d):
    return R.replace_scope(shared(spark, d, _OLD), shared(spark, d, _NEW), ["scope"])


@_query(_both("SELECT o.k, o.a, coalesce(o.b, n.b) AS b, o.scope FROM o LEFT JOIN n USING (k)"))
def update_from_join(spark, d):
    return R.update_from(shared(spark, d, _OLD), shared(spark, d, _NEW), ["k"], ["b"])


_VENDORS = f"SELECT concat('v', {_N.format('s_suppkey')}) AS company_key, concat(CASE WHEN s_suppkey % 2 = 0 THEN 'ACME ' ELSE 'Acme  ' END, {_N.format('s_suppkey % 30')}, CASE WHEN s_suppkey % 3 = 0 THEN ' Ltd.' ELSE ' ltd' END) AS company_name, 1000 - s_suppkey AS created_at FROM supplier"
_DOCS = f"SELECT c_custkey AS id, concat('v', {_N.format('c_custkey % 100')}) AS company_key, concat('h', {_N.format('c_custkey % 90')}) AS file_hash, CASE WHEN c_custkey % 2 = 0 THEN 'gst' ELSE 'pan' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS reviewed FROM customer"
_KEYED = f"v AS (SELECT *, trim(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM ({_VENDORS})), o AS (SELECT norm, min((created_at, company_name, company_key))[3] AS new_key FROM v GROUP BY norm), t AS (SELECT v.*, o.new_key FROM v JOIN o USING (norm))"


def _merge(spark, d):
    docs = shared(spark, d, _DOCS).withColumn("types", F.array("kind")).drop("kind")
    return C.merge_companies(shared(spark, d, _VENDORS), docs)


@_query(f"WITH {_KEYED} SELECT company_key, company_name FROM t WHERE company_key = new_key")
def merged_companies(spark, d):
    return _merge(spark, d)[0].select("company_key", "company_name")


@_query(f"WITH {_KEYED} SELECT coalesce(t.new_key, x.company_key) AS company_key, file_hash, min(id) AS id, list_sort(list_distinct(list(kind))) AS types, max(reviewed) AS reviewed FROM ({_DOCS}) x LEFT JOIN t USING (company_key) GROUP BY 1, 2")
def merged_documents(spark, d):
    return _merge(spark, d)[1]


@_query(f"WITH {_KEYED} SELECT company_key AS old_key, new_key, company_name AS alias FROM t WHERE company_key <> new_key")
def merge_aliases(spark, d):
    return _merge(spark, d)[2]


_KNOWN = ["Acme Industries Pvt Ltd", "Beta Medical Systems", "Beta Surgical", "Gamma", "Delta Care Hospital Supply", "Acme Industries Labs"]
_ASKED = ["ACME industries", "acme", "beta", "Beta Medical", "Gamma Equipment Company", "Delta Care", "delta", "Omega", "acme industries pvt. ltd", "", "Beta Surgical Private Limited"]


def _core_sql(c: str) -> str:
    words = f"list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    spelt = f"list_transform({words}, lambda w: CASE w WHEN 'pvt' THEN 'private' WHEN 'ltd' THEN 'limited' WHEN 'co' THEN 'company' ELSE w END)"
    return f"string_split(trim(regexp_replace(array_to_string({spelt}, ' '), '( ?(private|limited|incorporated|corporation|company))+$', '')), ' ')"


@_query(f"""WITH a(name) AS (VALUES {', '.join(f"('{x}')" for x in _ASKED)}), k(company) AS (VALUES {', '.join(f"('{x}')" for x in _KNOWN)}), x AS (SELECT name, company, {_core_sql('name')} AS p, {_core_sql('company')} AS q,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS same FROM a, k WHERE name <> ''),
 m AS (SELECT name, company, same FROM x WHERE same OR (p[1] = q[1] AND (len(p) = 1 OR len(q) = 1 OR p[2] = q[2]))), e AS (SELECT name, company FROM m WHERE same OR name NOT IN (SELECT name FROM m WHERE same))
 SELECT a.name, CASE WHEN count(DISTINCT company) = 1 THEN min(company) END AS company, count(DISTINCT company) AS matches FROM a LEFT JOIN e USING (name) GROUP BY a.name""")
def company_aliases(spark, d):
    return C.alias_matches(spark.createDataFrame([(x,) for x in _ASKED], "n string"), "n", spark.createDataFrame([(x,) for x in _KNOWN], "k string"), "k")


_UPLOADS = f"SELECT concat('/up/', {_pick('p_partkey % 4', 'p_brand', 'p_name', 'p_type', chr(39) + 'x' + chr(39))}, ' ', {_N.format('p_size')}, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_name) ELSE '' END, '.pdf') AS path FROM part"


@_query(f"""WITH f AS (SELECT DISTINCT path AS file, ' ' || trim(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS h FROM ({_UPLOADS})), k AS (SELECT DISTINCT p_name AS company, lower(p_name) AS key FROM part UNION SELECT DISTINCT p_type, lower(p_type) FROM part),
 m AS (SELECT file, company, key FROM f JOIN k ON length(key) >= 3 AND contains(h, ' ' || key || ' ')), b AS (SELECT file, max_by((key, company), (length(key), key)) AS b, list(key) AS keys FROM m GROUP BY file)
 SELECT f.file, CASE WHEN len(list_filter(keys, lambda x: NOT contains(b[1], x))) = 0 THEN b[2] END AS company FROM f LEFT JOIN b USING (file)""")
def companies_in_names(spark, d):
    part = _read(spark, d, "part")
    known = part.select(F.col("p_name").alias("c")).unionByName(part.select(F.col("p_type").alias("c")))
    return C.company_in_name(shared(spark, d, _UPLOADS), "path", known, "c")


_SOURCES = f"SELECT c_mktsegment AS company, concat('/in/', {_N.format('c_nationkey % 3')}, '/', CASE WHEN c_custkey % 2 = 0 THEN 'Doc ' ELSE 'doc ' END, {_N.format('c_custkey % 20')}, '.PDF') AS path, concat('h', {_N.format('c_custkey % 200')}) AS digest FROM customer"


@_query(f"""WITH o AS (SELECT company, digest, min(path) AS path FROM ({_SOURCES}) GROUP BY 1, 2), p AS (SELECT *, regexp_replace(company, '[^A-Za-z0-9._-]+', '_', 'g') AS folder, regexp_replace(regexp_extract(path, '[^/]*$'), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM o),
 n AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY path, digest) AS n FROM p) SELECT path, folder, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || n || regexp_extract(name, '\\.[^.]*$') END AS dest FROM n""")
def folder_plan(spark, d):
    return C.folder_plan(shared(spark, d, _SOURCES), "company", "path", "digest")


_SAVED = "SELECT concat('/b/', CAST(doc_id AS STRING)) AS path, text AS content FROM documents WHERE doc_id % 10 <> 1"
_FOUND = "SELECT concat('/b/', CAST(doc_id AS STRING)) AS path, CASE WHEN doc_id % 10 = 2 THEN concat(text, 'x') ELSE text END AS content FROM documents WHERE doc_id % 10 <> 3"


@_query("SELECT '/b/' || doc_id AS path, CASE doc_id % 10 WHEN 1 THEN 'unexpected' WHEN 2 THEN 'changed' ELSE 'missing' END AS problem FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def restore_check(spark, d):
    return C.verify(C.manifest(shared(spark, d, _SAVED)), C.manifest(shared(spark, d, _FOUND)))


@_query(f"SELECT * FROM ({_VENDORS}) WHERE company_key NOT IN (SELECT company_key FROM ({_DOCS}) WHERE id % 4 <> 0)")
def vendors_without_documents(spark, d):
    docs, gone = shared(spark, d, _DOCS), shared(spark, d, f"SELECT id FROM ({_DOCS}) x WHERE id % 4 = 0")
    kept, _ = C.delete_documents(docs, docs.select(F.col("id").alias("document_id")), gone)
    return C.orphan_vendors(shared(spark, d, _VENDORS), kept)


@_query(f"SELECT id, CASE WHEN id % 6 = 0 THEN 'fixed' ELSE company_key END AS company_key, CASE WHEN id % 6 = 3 THEN ['cin'] ELSE [kind] END AS types, CASE WHEN id % 3 = 0 THEN 1 ELSE reviewed END AS reviewed FROM ({_DOCS})")
def corrected_documents(spark, d):
    docs = shared(spark, d, _DOCS).select("id", "company_key", F.array("kind").alias("types"), "reviewed")
    fix = docs.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "fixed").alias("company_key"), F.when(F.col("id") % 6 == 3, F.array(F.lit("cin"))).alias("types"))
    return C.correct_documents(docs, fix)


@_query("SELECT min(n) AS company_name, k AS company_key FROM (SELECT n, lower(replace(n, '#', ' ')) AS k FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE upper(s_name) END AS n FROM supplier UNION ALL SELECT s_name FROM supplier)) GROUP BY k")
def vendor_masters(spark, d):
    s = _read(spark, d, "supplier")
    rows = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("Company"), F.upper("s_name").alias("Vendor")).unionByName(s.select(F.col("s_name").alias("Company"), F.lit(None).cast("string").alias("Vendor")))
    return C.vendor_master(rows, ["Company", "Vendor", "Absent"])
