"""Queries of the record, offer, classification and retrieval operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as T
from tidemark.functions import validate as V
from tidemark.operators import linkage as L
from tidemark.operators import offers as O
from tidemark.operators import retrieval as S
from tidemark.plans.catalogue import _SORTED, _query, _ratio_sql, _read
from tidemark.scratch import checkpointer

_SPACE = r"[\s\p{Cc}\p{Z}\x{85}]+"


def _normal(c: str) -> str:
    """SQL of the normal form of a text."""
    squeezed = f"trim(regexp_replace(coalesce({c}, ''), '{_SPACE}', ' ', 'g'))"
    nulls = ", ".join("'" + v + "'" for v in T.NULL_LIKE)
    kept = f"CASE WHEN lower({squeezed}) IN ({nulls}) THEN '' ELSE lower({squeezed}) END"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace({kept}, '&', ' and '), '[''’`]', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@_query(f"SELECT doc_id, md5({_normal('text')}) AS normal_md5 FROM documents")
def normal_texts(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(T.normal(F.col("text"))).alias("normal_md5"))


_GST14 = "lpad((s_nationkey % 37 + 1)::VARCHAR, 2, '0') || 'AABCA' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') || 'A1Z'"


@_query(f"""SELECT s_suppkey, g || substr('{V.GSTIN_ALPHABET}', ((36 - total % 36) % 36 + 1)::BIGINT, 1) AS gstin, true AS good, false AS broken
 FROM (SELECT s_suppkey, g, list_sum(list_transform(range(1, 15), lambda i: ((strpos('{V.GSTIN_ALPHABET}', substr(g, i, 1)) - 1) * (2 - i % 2)) // 36 + ((strpos('{V.GSTIN_ALPHABET}', substr(g, i, 1)) - 1) * (2 - i % 2)) % 36)) AS total
 FROM (SELECT s_suppkey, {_GST14} AS g FROM supplier))""")
def gstin_checks(spark, d):
    first = F.concat(F.lpad((F.col("s_nationkey") % 37 + 1).cast("string"), 2, "0"), F.lit("AABCA"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit("A1Z"))
    made = _read(spark, d, "supplier").select("s_suppkey", first.alias("g")).withColumn("gstin", F.concat("g", V.gstin_check(F.col("g"))))
    wrong = F.concat("g", F.translate(F.right("gstin", F.lit(1)), V.GSTIN_ALPHABET, V.GSTIN_ALPHABET[1:] + V.GSTIN_ALPHABET[0]))
    return made.select("s_suppkey", "gstin", V.gstin_valid(F.col("gstin")).alias("good"), V.gstin_valid(wrong).alias("broken"))


@_query(r"""SELECT host, count(*) AS pages, count(DISTINCT site) AS sites FROM (SELECT lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '')) AS host,
 regexp_replace(lower(regexp_extract(regexp_replace(url, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//', ''), '^([^/?#\s]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(regexp_replace(url, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//', ''), '^[^/?#\s]*(/[^?#\s]*)', 1), '/+$', '') AS site FROM pages) GROUP BY host""")
def web_hosts(spark, d):
    p = _read(spark, d, "pages").select(V.host(F.col("url")).alias("host"), V.website(F.col("url")).alias("site"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("site").alias("sites"))


_SMALL = ", ".join("'" + w + "'" for w in V.SMALL_WORDS)


@_query(f"""SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_name || ' of the ' || p_type), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ({_SMALL}) THEN w ELSE upper(w[1]) || w[2:] END), 'string_agg', ' ') AS title FROM part""")
def part_titles(spark, d):
    return _read(spark, d, "part").select("p_partkey", V.title_case(F.concat_ws(" of the ", "p_name", "p_type")).alias("title"))


_GOODS = ["surgical gloves", "paracetamol tablets", "tablet counter", "garden hose", "x-ray viewer", ""]
_AMOUNTS = ["₹1,250.50", "100-200", "0", "", "75", "on request"]
_pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
_sql_pick = lambda values, key: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({key}) % {len(values)} + 1]"


@_query(rf"""SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)\b(?:{C.MEDICINE})\b') AND NOT device THEN 'excluded' WHEN price <> '' AND (amount IS NULL OR amount < 0.01) THEN 'review' WHEN price = '' AND p_size % 2 = 0 THEN 'review'
 WHEN p_size > 45 THEN 'review' WHEN NOT device AND NOT regexp_matches(t, '(?i)\b(?:{C.MEDICAL})\b') THEN 'review' ELSE 'approved' END AS status
 FROM (SELECT *, regexp_matches(t, '(?i)\b(?:{C.DEVICE})\b') AS device, CASE price WHEN '₹1,250.50' THEN 1250.5 WHEN '0' THEN 0 WHEN '75' THEN 75 END AS amount
 FROM (SELECT p_partkey, p_size, p_name || ' ' || {_sql_pick(_GOODS, 'p_partkey')} AS t, {_sql_pick(_AMOUNTS, 'p_partkey // 6')} AS price FROM part))""")
def product_policies(spark, d):
    p = _read(spark, d, "part")
    name = F.concat_ws(" ", "p_name", _pick(_GOODS, F.col("p_partkey")))
    verdict = C.product_policy(name, [], F.when(F.col("p_size") % 2 == 0, "price").otherwise("product"), _pick(_AMOUNTS, F.floor(F.col("p_partkey") / 6)), {"GST": ((F.col("p_size") + 55).cast("string"), 100.0)})
    return p.select("p_partkey", verdict["status"].alias("status"))


_FILES = ["GST certificate.pdf", "md-5 licence.PDF", "MD 123.pdf", "udyog aadhaar card.jpg", "ISO9001 & CE.pdf", "company registration pan.pdf", "form16.pdf", "Form 16 A.pdf", "aadhar_front.png",
          "rate list 2024.xlsx", "product_catalogue.pdf", "cancelled cheque.jpg", "bank detail letter.pdf", "trade mark.docx", "lut challan.pdf", "notes.txt"]
_FOUND = ["GST", "MD", "", "Udyam", "ISO", "", "Form 16", "", "Aadhar", "Price", "Catalogue", "Cancelled Cheque", "", "", "", ""]
_SUPPORT = ["", "", "", "", "CE", "Incorporation", "", "", "", "", "Brochure", "", "Bank details", "Trademark", "Invoice / challan", ""]


@_query(f"SELECT s_suppkey, {_sql_pick(_FOUND, 's_suppkey')} AS types, {_sql_pick(_SUPPORT, 's_suppkey')} AS supporting FROM supplier")
def document_kinds(spark, d):
    path = F.concat(F.lit("vendors/"), "s_name", F.lit("/"), _pick(_FILES, F.col("s_suppkey")))
    return _read(spark, d, "supplier").select("s_suppkey", F.array_join(C.document_types(path), ",").alias("types"), C.supporting_category(path).alias("supporting"))


_CHAT = C.CHAT_PRICE.replace("'", "''")


@_query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'offer' WHEN 1 THEN 'unclear' WHEN 2 THEN 'offer' END AS kind, CASE WHEN o_orderkey % 4 IN (0, 2) THEN round(o_totalprice, 2) END AS price,
 CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'Item ' || o_custkey END AS product, CASE WHEN o_orderkey % 4 = 0 THEN 'INR' WHEN o_orderkey % 4 = 2 THEN '' END AS currency FROM orders""")
def chat_offers(spark, d):
    o = _read(spark, d, "orders")
    amount = F.format_number("o_totalprice", 2)
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Item "), "o_custkey", F.lit(" for Rs. "), amount)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Item at Rs 5 or ₹ "), amount)).when(
        F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Item "), "o_custkey", F.lit(" price is "), amount)).otherwise("good morning")
    x = C.chat_offer(F.concat(F.lit("[01/02/24, 9:30 am] Asha: "), said))
    r = o.select("o_orderkey", x.alias("x"))
    mine = F.col("x.kind") == "offer"
    return r.select("o_orderkey", "x.kind", *[F.when(mine, F.col(f"x.{c}")).alias(c) for c in ("price", "product", "currency")])


@_query("""SELECT l_orderkey, l_linenumber, round(s, 2)::DOUBLE AS subtotal, round(s * di, 2)::DOUBLE AS discount_amount, round(s - s * di, 2)::DOUBLE AS taxable_amount, round((s - s * di) * t, 2)::DOUBLE AS tax_amount, round((s - s * di) * (1 + t), 2)::DOUBLE AS final_amount
 FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12,2) AS s, l_discount::DECIMAL(4,2) AS di, l_tax::DECIMAL(4,2) AS t FROM lineitem)""")
def quote_totals(spark, d):
    dec = lambda c, t: F.col(c).cast(t)
    q = C.quote(dec("l_extendedprice", "decimal(12,2)"), F.lit(1), dec("l_discount", "decimal(4,2)"), dec("l_tax", "decimal(4,2)"), F.lit(0).cast("decimal(4,2)"))
    got = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"))
    return got.select("l_orderkey", "l_linenumber", *[F.col(f"q.{c}").cast("double").alias(c) for c in ("subtotal", "discount_amount", "taxable_amount", "tax_amount", "final_amount")])


@_query("""SELECT l_partkey, l_orderkey, l_linenumber, rank, price - min_price AS over_lowest, offers FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY price, l_orderkey, l_linenumber, l_suppkey) AS rank,
 min(price) OVER (PARTITION BY l_partkey) AS min_price, count(*) OVER (PARTITION BY l_partkey) AS offers FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_quantity > 0)) WHERE rank <= 3""")
def best_offers(spark, d):
    line = _read(spark, d, "lineitem").where("l_quantity > 0").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return O.ranked_offers(line, ["l_partkey"], "price", ["l_orderkey", "l_linenumber", "l_suppkey"], 3).select("l_partkey", "l_orderkey", "l_linenumber", "rank", "over_lowest", "offers")


@_query("SELECT p_name, p_brand, count(*) AS rows, CASE WHEN count(DISTINCT p_retailprice) > 1 OR count(DISTINCT p_size) > 1 THEN 'conflict' ELSE 'possible duplicate' END AS issue FROM part GROUP BY ALL HAVING count(*) > 1")
def price_conflicts(spark, d):
    return O.price_conflicts(_read(spark, d, "part"), ["p_name", "p_brand"], ["p_retailprice", "p_size"]).select("p_name", "p_brand", "rows", "issue")


@_query("SELECT l_partkey, l_quantity, l_discount, min(l_orderkey * 10 + l_linenumber) AS id, count(*) AS copies FROM lineitem GROUP BY l_partkey, l_quantity, l_discount, CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END")
def catalogue_unique(spark, d):
    rows = _read(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return O.unique_rows(rows, "id", ["l_partkey", "l_quantity", "l_discount"], F.col("l_returnflag") == "R").select("l_partkey", "l_quantity", "l_discount", "id", "copies")


_CUR = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'sku' || p_partkey ELSE '' END AS sku, p_name AS name, p_type AS pack, p_size::VARCHAR AS unit, p_brand, p_retailprice AS price FROM part"
_NEW = "SELECT id, CASE WHEN id % 2 = 0 THEN sku ELSE '' END AS sku, CASE WHEN id % 7 = 0 THEN name || ' new' ELSE name END AS name, pack, unit, p_brand, CASE WHEN id % 5 = 0 THEN price + 1 ELSE price END AS price"


@_query(f"""WITH cur AS ({_CUR}), new AS ({_NEW} FROM cur), m AS (SELECT n.id, count(DISTINCT c.id) AS matches, min(c.id) AS cid FROM new n JOIN cur c ON n.p_brand = c.p_brand AND n.pack = c.pack AND n.unit = c.unit
 AND CASE WHEN n.sku <> '' AND c.sku <> '' THEN n.sku = c.sku ELSE n.name = c.name END GROUP BY n.id)
 SELECT new.id, CASE WHEN matches IS NULL THEN 'insert' WHEN matches > 1 THEN 'ambiguous' WHEN new.price <> cur.price THEN 'price_change' WHEN new.name <> cur.name THEN 'update' ELSE 'duplicate' END AS outcome,
 CASE WHEN matches = 1 THEN cid END AS product FROM new LEFT JOIN m ON new.id = m.id LEFT JOIN cur ON cur.id = cid""")
def staged_outcomes(spark, d):
    cur = _read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("sku"), "p_partkey")).otherwise("").alias("sku"), F.col("p_name").alias("name"),
        F.col("p_type").alias("pack"), F.col("p_size").cast("string").alias("unit"), "p_brand", F.col("p_retailprice").alias("price"))
    new = cur.select("id", F.when(F.col("id") % 2 == 0, F.col("sku")).otherwise("").alias("sku"), F.when(F.col("id") % 7 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"), "pack", "unit", "p_brand", F.when(F.col("id") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    return O.staged_outcome(new, cur, ["p_brand"]).select("id", "outcome", "product")


@_query("SELECT s AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(s)")
def status_totals(spark, d):
    return O.zero_filled(_read(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@_query("SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS messages FROM events GROUP BY user_id")
def issue_messages(spark, d):
    return O.messages(_read(spark, d, "events"), "user_id", "event_type")


@_query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def first_modes(spark, d):
    return L.first_mode(_read(spark, d, "events"), "user_id", "event_type", "event_id")


@_query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey // 2 AS into_id FROM customer WHERE c_custkey % 10 <> 0),
 walk AS (SELECT id, into_id AS target FROM p UNION ALL SELECT w.id, p.into_id FROM walk w JOIN p ON w.target = p.id) SELECT id, min(target) AS target FROM walk GROUP BY id""")
def canonical_pointers(spark, d):
    p = _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, F.floor(F.col("c_custkey") / 2)).alias("merged_into"))
    return L.canonical(p, checkpointer(spark, "pointers"))


@_query("SELECT text, list_sort(list_distinct(list(source)))::VARCHAR[] AS source, count(*) AS copies, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM documents GROUP BY text")
def combined_documents(spark, d):
    docs = _read(spark, d, "documents").select("text", "doc_id", F.array("source").alias("source"), "n_chars")
    return O.combine_documents(docs, ["text"], F.struct("n_chars", (-F.col("doc_id")).alias("o")), "source").select("text", "source", "copies", "doc_id")


@_query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal IS NULL, s_acctbal, s_suppkey LIMIT 50 OFFSET 20")
def supplier_page(spark, d):
    return O.page(_read(spark, d, "supplier"), [F.col("s_acctbal").isNull(), F.col("s_acctbal"), F.col("s_suppkey")], 20, 50).select("s_suppkey", "s_name")


@_query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def nation_keys(spark, d):
    return _read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(_read(spark, d, "supplier").select("s_nationkey")).distinct()


@_query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_values(spark, d):
    m = F.from_json("props", "map<string,string>")
    return _read(spark, d, "events").select(F.try_element_at(m, F.lit("k")).cast("long").alias("k"), "user_id").groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@_query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def type_coverage(spark, d):
    return _read(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@_query("""SELECT user_id, count(*) FILTER (gap IS NULL OR gap > 86400) AS sessions, count(*) AS n FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY user_id""")
def session_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)
    e = _read(spark, d, "events").select("user_id", (at - F.lag(at).over(w)).alias("gap"))
    return e.groupBy("user_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > 86400)).alias("sessions"), F.count("*").alias("n"))


@_query(f"""WITH p AS (SELECT doc_id, s // 1000 AS passage_no, ' ' || {_normal('substr(text, s::BIGINT + 1, 1200)')} || ' ' AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS s FROM documents)),
 q AS (SELECT *, contains(h, ' the ')::INT + contains(h, ' with ')::INT + contains(h, ' of ')::INT AS hits, contains(h, ' the ')::INT * 0.75 + contains(h, ' with ')::INT * 1.0 + contains(h, ' of ')::INT * 0.5 AS len FROM p),
 r AS (SELECT doc_id, passage_no, hits::INT AS hits, (4 * hits + len)::DOUBLE AS score FROM q WHERE hits >= 2)
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, passage_no) AS rank FROM r QUALIFY rank <= 3""")
def passage_search(spark, d):
    return S.passage_hits(_read(spark, d, "documents"), "doc_id", "text", "the with of").withColumn("passage_no", F.col("passage_no").cast("long"))


@_query("""WITH names AS (SELECT DISTINCT p_name FROM part), words AS (SELECT p_name, ' ' || unnest(string_split(p_name, ' ')) || ' ' AS w FROM names),
 g AS (SELECT p_name, CASE WHEN length(w) <= n THEN w ELSE substr(w, i::BIGINT, n) END AS gram FROM words, (VALUES (3), (4)) t(n), unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) u(i)),
 tf AS (SELECT p_name, gram, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
 raw AS (SELECT p_name, gram, tf * (ln((1 + (SELECT count(*) FROM names)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (gram)), nrm AS (SELECT p_name, sqrt(sum(raw * raw)) AS nrm FROM raw GROUP BY 1),
 v AS (SELECT p_name, gram, raw / nrm AS w FROM raw JOIN nrm USING (p_name)), c AS (SELECT a.p_name AS l, b.p_name AS r, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.gram = b.gram AND a.p_name <> b.p_name GROUP BY ALL)
 SELECT * FROM c WHERE cosine >= 0.5""")
def nearest_names(spark, d):
    names = _read(spark, d, "part").select("p_name").distinct()
    got = S.nearest_names(names, "p_name", F.col("p_name"), checkpointer(spark, "names"), k=1000)
    return got.withColumn("cosine", F.round("cosine", 6))


@_query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1::DOUBLE) * (x::DOUBLE - 0.1::DOUBLE))), 6) AS distance FROM embeddings ORDER BY list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1::DOUBLE) * (x::DOUBLE - 0.1::DOUBLE))), vec_id LIMIT 10""")
def nearest_vectors(spark, d):
    e = _read(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return S.nearest_vectors(e, "vec_id", "embedding", [0.1] * size).withColumn("distance", F.round("distance", 6))


@_query(f"""WITH n AS (SELECT p_name AS n, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT x.id AS l, y.id AS r, x.n AS a, y.n AS b, {_SORTED.format('x.n')} AS sa, {_SORTED.format('y.n')} AS sb
  FROM n x JOIN n y ON substr(x.n, 1, 1) = substr(y.n, 1, 1) AND x.id < y.id),
 s AS (SELECT l, r, greatest({_ratio_sql('a', 'b')}, {_ratio_sql('sa', 'sb')}) AS score FROM p) SELECT * FROM s WHERE score >= 60""")
def close_names(spark, d):
    """Distinct part names of one initial that are 60 alike."""
    return L.close_names(_read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", F.left("p_name", F.lit(1)), least=60.0)


@_query(None)
def resolved_records(spark, d):
    """Parts as records in arrival order: greedy linkage, which SQL cannot express."""
    rows = _read(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(""))).alias("name"), F.col("p_type").alias("city"))
    return L.resolve(rows, checkpointer(spark, "resolve"))
