"""Queries of header mapping and text extraction, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lines as N
from tidemark.operators import schema as S
from tidemark.plans.catalogue import _query, _ratio_sql, _read
from tidemark.plans.cleaning import RAW, _pick, raw_records
from tidemark.plans.extended import _normal

HEADERS = [
    "Hospital Name", "NAME OF HOSPITAL", "Contact Person Name", "Adress", "Complete Address", "E-mail ID", "Mobile No.", "Phone Numbr", "Pin Code", "State", "District Name", "Type of Hospital",
    "Sr. No.", "", "Remarks", "Registration Numbr", "GSTIN of firm", "Citty", "Town", "Web site address", "Person name", "Webs", "Name", "Doctor Name", "Company's Name", "Owner Phone", "Bank Account",
    "State UT", "Hospitl Name", "Categry", "zila", "PIN", "Tel No", "Licence No", "ignored", "forced one",
]
OVERRIDES = {"ignored": "ignore", "Forced One": "category", "a.csv::Remarks": "address"}
_ALIAS = ", ".join(f"({n}, '{a}', '{f}')" for n, (a, f) in enumerate(S.Spelling().by_alias().items()))
_PERSON = " OR ".join(f"contains(p, ' {w} ')" for w in S.NEVER_NAME)


def _phrases(words, every: bool) -> str:
    return "(" + (" AND " if every else " OR ").join(f"contains(p, ' {w} ')" for w in words) + ")"


_RULES = " ".join(f"WHEN {_phrases(w, e)}{' AND NOT person' if f == 'name' else ''} THEN '{f}'" for f, e, w in S.KEYWORDS)
_RULE_SURE = " ".join(f"WHEN {_phrases(w, e)}{' AND NOT person' if f == 'name' else ''} THEN {0.8 if e else 0.85}" for f, e, w in S.KEYWORDS)
#: Fields of headers ``h`` in DuckDB, from a relation ``hd(h)``.
MATCHED = f"""alias(no, a, f) AS (VALUES {_ALIAS}), x AS (SELECT h, {_normal('h')} AS n, ' ' || {_normal('h')} || ' ' AS p FROM hd),
 y AS (SELECT *, ({_PERSON}) AS person FROM x), e AS (SELECT y.*, alias.f AS exact, CASE {_RULES} END AS rule, CASE {_RULE_SURE} END AS sure FROM y LEFT JOIN alias ON n = a),
 z AS (SELECT h, a, f, no, {_ratio_sql('n', 'a')} AS s FROM e JOIN alias ON length(a) >= 4 AND length(n) >= 4 WHERE exact IS NULL AND rule IS NULL),
 b AS (SELECT h, max_by(f, (s, -no)) AS f, max(s) AS s FROM z GROUP BY h),
 m AS (SELECT h, n, CASE WHEN n = '' THEN NULL WHEN exact IS NOT NULL THEN CASE WHEN person AND exact = 'name' THEN NULL ELSE exact END WHEN rule IS NOT NULL THEN rule WHEN b.s >= 90 AND NOT (person AND b.f = 'name') THEN b.f END AS field,
  exact IS NOT NULL AS is_exact, rule, sure, b.s AS s FROM e LEFT JOIN b USING (h)),
 matched AS (SELECT h, field, CASE WHEN field IS NULL THEN 0 WHEN is_exact THEN 1 WHEN rule IS NOT NULL THEN sure ELSE round(s / 100 * 0.9, 2) END::DOUBLE AS confidence, CASE WHEN field IS NULL THEN 'none' WHEN is_exact THEN 'exact' WHEN rule IS NOT NULL THEN 'keyword' ELSE 'fuzzy' END AS method FROM m)"""


def _list(values) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


@_query(f"WITH hd(h) AS (VALUES {_list(HEADERS)}), {MATCHED} SELECT h AS header, field, confidence, method FROM matched")
def header_matches(spark, d):
    df = spark.createDataFrame([(h,) for h in HEADERS], "header string")
    return S.header_fields(df, "header")


@_query(f"""WITH hd(h) AS (VALUES {_list(HEADERS)}), {MATCHED} SELECT h AS header, CASE h WHEN 'ignored' THEN NULL WHEN 'forced one' THEN 'category' WHEN 'Remarks' THEN 'address' ELSE field END AS field,
 CASE WHEN h IN ('ignored', 'forced one', 'Remarks') THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN h IN ('ignored', 'forced one', 'Remarks') THEN 'override' ELSE method END AS method FROM matched""")
def header_overrides(spark, d):
    df = spark.createDataFrame([(h,) for h in HEADERS], "header string")
    return df.withColumn("_m", S.match_header(F.col("header"), S.Spelling(overrides=OVERRIDES), F.lit("a.csv"))).select("header", "_m.*")


#: Rows of files; cells part at a bar.
FILES = f"""SELECT concat('file', CAST(c_custkey % 40 AS STRING)) AS path, CAST(floor(c_custkey / 40) + 1 AS INT) AS row,
 CASE WHEN floor(c_custkey / 40) = c_custkey % 4 THEN {_pick('c_custkey % 40 % 5', "'Hospital Name|Town|Mobile No|Remarks'", "'Sr No|Name|E-mail|E-mail'", "'Company|1|2'", "'Registrtion Number|Adress'", "'Title|Other'")}
  WHEN floor(c_custkey / 40) = 5 THEN '12|34|56' WHEN floor(c_custkey / 40) = 6 THEN 'only one' WHEN floor(c_custkey / 40) = 7 THEN '||' WHEN floor(c_custkey / 40) = 8 THEN 'hospital name|TOWN|mobile no|remarks' ELSE concat('Lotus ', CAST(c_custkey AS STRING), '|Kota|9876500011|x|more') END AS line FROM customer WHERE c_custkey < 400"""


def _files(spark, d):
    _read(spark, d, "customer").createOrReplaceTempView("_tidemark_customer")
    return spark.sql(FILES.replace("FROM customer", "FROM _tidemark_customer")).select("path", "row", F.split("line", r"\|").alias("cells"))


_CELLS = f"""files AS ({FILES}), cells AS (SELECT path, row, trim(unnest(string_split(line, '|'))) AS c FROM files WHERE row <= 40), filled AS (SELECT path, row, c FROM cells WHERE c <> ''),
 good AS (SELECT path, row FROM filled GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (regexp_full_match(c, '[0-9.,/ -]+')) <= count(*) / 2), hd AS (SELECT DISTINCT c AS h FROM filled JOIN good USING (path, row)), {MATCHED},
 known AS (SELECT path, row, count(DISTINCT field) AS k, max((field = 'name')::INT) AS named FROM filled JOIN good USING (path, row) JOIN matched ON c = h WHERE field IS NOT NULL GROUP BY 1, 2),
 best AS (SELECT path, arg_max(row, (k, -row)) AS header_row, max(k)::INT AS known FROM known WHERE k >= 2 OR named = 1 GROUP BY path)"""


@_query(f"WITH {_CELLS} SELECT * FROM best")
def header_row_found(spark, d):
    return S.header_rows(_files(spark, d), ["path"])


@_query(f"""WITH {_CELLS}, j AS (SELECT f.path, f.row, line, (SELECT line FROM files g WHERE g.path = b.path AND g.row = b.header_row) AS head FROM files f JOIN best b ON f.path = b.path AND f.row > b.header_row)
 SELECT path, count(*) FILTER (replace(line, '|', '') = '') AS blank, count(*) FILTER (replace(line, '|', '') <> '' AND lower(line) = lower(head)) AS repeated FROM j GROUP BY path""")
def rows_left_out(spark, d):
    """Blank rows and repeated headers below each file's header."""
    rows = _files(spark, d)
    found = S.header_rows(rows, ["path"]).join(rows.withColumnRenamed("row", "header_row").withColumnRenamed("cells", "header"), ["path", "header_row"])
    return S.data_rows(rows, found.select("path", "header_row", "header"), ["path"])[1]


@_query(f"""WITH r AS ({RAW}), c AS (SELECT seq % 20 AS block, seq, original_email AS e, original_website AS w, original_phone AS p, original_registration_id AS g FROM r),
 s AS (SELECT block, 0 AS idx, trim(e) AS v FROM c UNION ALL SELECT block, 1, trim(w) FROM c UNION ALL SELECT block, 2, trim(p) FROM c UNION ALL SELECT block, 3, trim(g) FROM c UNION ALL SELECT block, 4, 'www.a' || seq || '.in' FROM c UNION ALL SELECT block, 5, CASE WHEN seq % 3 = 0 THEN '' ELSE 'x' || seq || '@b.com' END FROM c
  UNION ALL SELECT block, 6, '98765' || (10000 + seq) FROM c),
 t AS (SELECT block, idx, count(*) FILTER (v <> '') AS n, avg(regexp_matches(v, '@[^@]*\\.[^@]*$')::INT) FILTER (v <> '') AS e, avg(regexp_matches(v, '^(?i)(https?://|www\\.)\\S+$')::INT) FILTER (v <> '') AS w, avg((regexp_full_match(v, '[LU][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}') OR regexp_full_match(v, '[A-Z]{{5}}[0-9]{{4}}[A-Z]'))::INT) FILTER (v <> '') AS g,
  avg((regexp_full_match(v, '\\+?[0-9 ().-]{{8,16}}') AND length(regexp_replace(v, '[^0-9]', '', 'g')) IN (10, 11, 12))::INT) FILTER (v <> '') AS p FROM s GROUP BY 1, 2)
 SELECT block, idx, CASE WHEN n < 2 THEN NULL WHEN e >= 0.6 THEN 'email' WHEN w >= 0.6 THEN 'website' WHEN g >= 0.6 THEN 'registration_id' WHEN p >= 0.6 THEN 'phone' END AS field FROM t""")
def sniffed_columns(spark, d):
    r = raw_records(spark, d).select((F.col("seq") % 20).alias("block"), F.posexplode(F.array(
        "original_email", "original_website", "original_phone", "original_registration_id", F.concat(F.lit("www.a"), "seq", F.lit(".in")), F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("x"), "seq", F.lit("@b.com"))),
        F.concat(F.lit("98765"), F.lit(10000) + F.col("seq")))).alias("idx", "v"))
    return r.groupBy("block", "idx").agg(F.collect_list("v").alias("sample")).select("block", "idx", S.sniff(F.col("sample")).alias("field"))


#: Columns of tables: two phone columns, two names of which one is surer, one that only its content gives away, and tables whose name does too.
_COLUMNS = """SELECT c_custkey % 30 AS block, c_custkey AS seq, CASE WHEN c_custkey % 30 % 2 = 0 THEN 'Hospitl Name' ELSE 'Title' END AS h0, CASE WHEN c_custkey % 30 % 4 = 0 THEN 'Name' ELSE 'Note' END AS h1, 'Mobile' AS h2, 'Phone 2' AS h3, 'Field' AS h4,
 concat('Lotus ', CAST(c_custkey AS STRING), ' Clinic') AS v0, 'abc' AS v1, '9876500011' AS v2, '9876500012' AS v3, concat('a', CAST(c_custkey AS STRING), '@b.in') AS v4 FROM customer"""


@_query(f"""WITH src AS ({_COLUMNS}), blocks AS (SELECT DISTINCT block, h0, h1 FROM src),
 t AS (SELECT block, 0 AS idx, h0 AS header, CASE WHEN h0 = 'Hospitl Name' THEN 'name' WHEN h1 = 'Name' THEN NULL ELSE 'name' END AS field, CASE WHEN h0 = 'Hospitl Name' THEN 'fuzzy' WHEN h1 = 'Name' THEN 'none' ELSE 'content' END AS method, h1 <> 'Name' AS used FROM blocks
  UNION ALL SELECT block, 1, h1, CASE WHEN h1 = 'Name' THEN 'name' END, CASE WHEN h1 = 'Name' THEN 'exact' ELSE 'none' END, h1 = 'Name' FROM blocks
  UNION ALL SELECT block, 2, 'Mobile', 'phone', 'exact', true FROM blocks UNION ALL SELECT block, 3, 'Phone 2', 'phone', 'exact', true FROM blocks UNION ALL SELECT block, 4, 'Field', 'email', 'content', true FROM blocks)
 SELECT block, idx, header, field, method, used FROM t""")
def mapped_columns(spark, d):
    return S.map_columns(_table_columns(spark, d), ["block"]).select("block", "idx", "header", "field", "method", "used")


def _column_rows(spark, d):
    _read(spark, d, "customer").createOrReplaceTempView("_tidemark_customer")
    return spark.sql(_COLUMNS.replace("FROM customer", "FROM _tidemark_customer"))


def _table_columns(spark, d):
    r = _column_rows(spark, d)
    c = r.select("block", F.posexplode(F.array(*[F.struct(F.col(f"h{k}").alias("header"), F.col(f"v{k}").alias("v")) for k in range(5)])).alias("idx", "c"))
    return c.groupBy("block", "idx", F.col("c.header").alias("header")).agg(F.slice(F.collect_list("c.v"), 1, 50).alias("sample"))


@_query(f"""WITH src AS ({_COLUMNS}) SELECT block, seq AS row, CASE WHEN h1 = 'Name' THEN 'abc' ELSE v0 END AS original_name, v2 || ' / ' || v3 AS original_phone, v4 AS original_email, '' AS original_city,
 sha256(block || '|' || seq)[1:32] AS record_id FROM src""")
def extracted_records(spark, d):
    mapped = S.map_columns(_table_columns(spark, d), ["block"])
    rows = _column_rows(spark, d).select("block", F.col("seq").alias("row"), F.array("v0", "v1", F.concat(F.lit(" "), "v2"), "v3", "v4").alias("cells"))
    return S.records(rows, mapped, ["block"]).select("block", "row", "original_name", "original_phone", "original_email", "original_city", "record_id")


@_query("""SELECT block, idx, CASE WHEN rn > 1 THEN h || '__' || rn ELSE h END AS header FROM (SELECT *, row_number() OVER (PARTITION BY block, lower(h) ORDER BY idx) AS rn FROM (
 SELECT c_custkey % 25 AS block, c_custkey // 25 AS idx, CASE c_custkey // 25 % 4 WHEN 0 THEN 'column_' || (c_custkey // 25 + 1) WHEN 1 THEN 'Phone' WHEN 2 THEN 'phone' ELSE c_mktsegment END AS h FROM customer))""")
def headers_made_unique(spark, d):
    idx = F.floor(F.col("c_custkey") / 25)
    h = _read(spark, d, "customer").select((F.col("c_custkey") % 25).alias("block"), idx.alias("idx"), F.when(idx % 4 == 0, F.lit("  ")).when(idx % 4 == 1, "Phone").when(idx % 4 == 2, " phone ").otherwise(F.col("c_mktsegment")).alias("header"))
    return S.unique_headers(h, ["block"])


@_query("""WITH b AS (SELECT c_custkey % 25 AS file, c_custkey // 25 AS no, CASE WHEN c_custkey // 25 % 5 = 0 THEN 'h' || c_custkey END AS h, c_custkey % 3 AS known, 3 + c_custkey % 4 AS width FROM customer),
 c AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY file ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM b)
 SELECT file, no, CASE WHEN h IS NOT NULL THEN h WHEN last IS NOT NULL AND abs(4 - width) <= 1 AND known < 2 THEN last END AS first_header, h IS NULL AND last IS NOT NULL AND abs(4 - width) <= 1 AND known < 2 AS carried FROM c""")
def headers_carried(spark, d):
    no = F.floor(F.col("c_custkey") / 25)
    b = _read(spark, d, "customer").select((F.col("c_custkey") % 25).alias("file"), no.alias("no"), F.when(no % 5 == 0, F.array(F.concat(F.lit("h"), "c_custkey"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("header"),
                                           (F.col("c_custkey") % 3).alias("known"), F.array_repeat(F.lit("x"), (3 + F.col("c_custkey") % 4).cast("int")).alias("first"))
    return S.carried_headers(b, ["file"], "no").select("file", "no", F.try_element_at("header", F.lit(1)).alias("first_header"), "carried")


#: Lines made of known parts, so that what is read back is known.
_LINES = f"""SELECT c_custkey AS seq, {_pick('c_custkey % 4', "', '", "' | '", "'; '", "', '")} AS gap, concat('Lotus', CAST(c_custkey AS STRING), ' Clinic') AS name, {_pick('c_custkey % 3', "'Kota'", "'Jaipur'", "''")} AS city, {_pick('c_custkey % 5', "'Rajasthan'", "''")} AS state,
 {_pick('c_custkey % 2', "'Plot 7 Tonk Road'", "''")} AS address, {_pick('c_custkey % 3', "''", "'302001'", "'324005'")} AS pin, {_pick('c_custkey % 4', "'9876500011'", "''", "'0141 2345678'", "''")} AS phone, {_pick('c_custkey % 3', "'info@lotus.in'", "''", "'a.b@c.org'")} AS email,
 {_pick('c_custkey % 7', "'www.lotus.in'", "''")} AS website, {_pick('c_custkey % 6', "'U12345RJ2010PTC123456'", "''")} AS reg FROM customer"""


def _lines(spark, d):
    _read(spark, d, "customer").createOrReplaceTempView("_tidemark_customer")
    r = spark.sql(_LINES.replace("FROM customer", "FROM _tidemark_customer"))
    parts = [F.concat(F.when(F.col("seq") % 4 == 3, F.concat("seq", F.lit(") "))).otherwise(""), "name"), F.col("address"), F.col("city"), F.col("state"), F.col("pin"), F.when(F.col("phone") != "", F.concat(F.lit("Ph: "), "phone")), F.col("email"), F.col("website"), F.col("reg")]
    return r.withColumn("text", F.array_join(F.filter(F.array_compact(F.array(*parts)), lambda p: p != ""), "\u0001")).withColumn("text", F.replace("text", F.lit("\u0001"), F.col("gap")))


@_query(f"SELECT seq, name, city, state, address, pin AS pincode, phone, email, website, reg AS registration_id FROM ({_LINES})")
def parsed_lines(spark, d):
    return _lines(spark, d).select("seq", N.parse(F.col("text")).alias("p")).select("seq", "p.name", "p.city", "p.state", "p.address", "p.pincode", "p.phone", "p.email", "p.website", "p.registration_id")


@_query(f"""WITH l AS ({_LINES}), t AS (SELECT *, city || state || pin || phone || email || website || reg AS other, concat_ws(gap, CASE WHEN seq % 4 = 3 THEN seq || ') ' ELSE '' END || name, nullif(address, ''), nullif(city, ''), nullif(state, ''), nullif(pin, ''),
 CASE WHEN phone <> '' THEN 'Ph: ' || phone END, nullif(email, ''), nullif(website, ''), nullif(reg, '')) AS text FROM l)
 SELECT seq, CASE WHEN seq % 11 = 0 AND other = '' THEN 'heading' WHEN len(regexp_extract_all(text, '\\w+')) >= 14 THEN 'prose' WHEN other = '' AND seq % 3 <> 2 THEN 'title_or_note' ELSE 'entity' END AS role FROM t""")
def text_roles(spark, d):
    r = _lines(spark, d)
    return r.withColumn("p", N.parse(F.col("text"))).select("seq", N.role(F.col("text"), F.col("p"), F.col("seq") % 11 == 0, F.col("seq") % 3 == 2).alias("role"))


@_query(f"""SELECT seq // 10 AS block, row_number() OVER (PARTITION BY seq // 10 ORDER BY seq) AS record, name, city, phone FROM ({_LINES})""")
def labelled_records(spark, d):
    """Label blocks of ten records each, read back; a city or phone that is empty has no line."""
    r = _lines(spark, d).select(F.floor(F.col("seq") / 10).alias("block"), F.posexplode(F.array(
        F.concat(F.lit("Hospital Name : "), "name"), F.when(F.col("city") != "", F.concat(F.lit("Town: "), "city")), F.when(F.col("phone") != "", F.concat(F.lit("Mobile No = "), "phone")), F.lit("see over"))).alias("k", "text"), "seq").where("text is not null")
    lined = N.labelled(r.select("block", (F.col("seq") * 10 + F.col("k")).alias("line"), "text"), ["block"], "line", "text")
    found = N.label_records(lined.join(N.label_blocks(lined, ["block"]).where("mode = 'label'").select("block"), "block", "left_semi"), ["block"], "line", "text")
    field = lambda n: F.coalesce(F.try_element_at("values", F.lit(n)), F.lit("")).alias(n)
    return found.select("block", F.col("record").cast("long").alias("record"), field("name"), field("city"), field("phone"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE (p_size + 0.5)::VARCHAR END AS cell FROM part")
def cells_as_text(spark, d):
    n = F.when(F.col("p_partkey") % 10 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.5)
    return _read(spark, d, "part").select("p_partkey", S.to_text(n).alias("cell"))
