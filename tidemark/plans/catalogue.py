"""Registry of the engine's own queries and of the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.names import Words
from tidemark.operators import linkage as L
from tidemark.operators import offers as O
from tidemark.operators import records as R
from tidemark.scratch import checkpointer

FLAGSHIP = "price_comparison"
_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_OFFERS = "SELECT p_name, p_brand, l_suppkey, l_extendedprice / l_quantity AS price, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0"


def _line_offers(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").where("l_quantity > 0").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_shipdate", "l_orderkey", "l_linenumber")


def _offers(spark: SparkSession, d: str) -> DataFrame:
    return _line_offers(spark, d).join(_read(spark, d, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


@_query(f"""SELECT p_name, p_brand, min(price) AS min_price, max(price) AS max_price, round(median(price), 7) AS median_price, count(DISTINCT l_suppkey) AS vendors,
 arg_min(l_suppkey, (price, l_suppkey)) AS best_vendor, max(price) - min(price) AS saving FROM ({_OFFERS}) GROUP BY ALL""")
def price_comparison(spark, d):
    g = R.price_statistics(_offers(spark, d), ["p_name", "p_brand"], "l_suppkey", "price")
    return g.drop("avg_price", "saving_on_mean")


@_query(f"""SELECT l_partkey, l_orderkey, l_linenumber, old_price, price AS new_price FROM (
 SELECT *, lag(price) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, price) AS old_price FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_quantity > 0)) WHERE old_price <> price""")
def price_history(spark, d):
    out = R.price_changes(_line_offers(spark, d).drop("l_suppkey"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "price"], "price", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "old_price", "new_price")


_KINDS = ["signup", "purchase", "view", "click", "error"]


@_query("SELECT c_custkey, " + ", ".join(f"CASE WHEN coalesce({k}, 0) = 1 THEN 'Yes' ELSE 'No' END AS {k}" for k in _KINDS) + ", " + " + ".join(f"coalesce({k}, 0)" for k in _KINDS) + " AS available, 5 - (" + " + ".join(f"coalesce({k}, 0)" for k in _KINDS) + ") AS missing, round(100.0::DOUBLE * (" + " + ".join(f"coalesce({k}, 0)" for k in _KINDS) + ") / 5, 1) AS completion, coalesce(files, 0) AS files FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN (SELECT user_id, count(*) AS files, " + ", ".join(f"max((event_type = '{k}')::BIGINT) AS {k}" for k in _KINDS) + " FROM events WHERE value > 5 GROUP BY user_id) ON c_custkey = user_id")
def document_checklist(spark, d):
    docs = _read(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    return R.checklist(_read(spark, d, "customer").select("c_custkey").distinct(), docs, "c_custkey", "event_type", _KINDS, F.col("value") > 5)


@_query("""SELECT p_partkey, p_name, p_brand, p_type, p_size, group_size, rn = 1 AS is_primary FROM (
 SELECT *, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY p_name, p_brand, p_type, p_size ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part WINDOW w AS (PARTITION BY p_name, p_brand, p_type, p_size)) WHERE group_size > 1""")
def duplicate_records(spark, d):
    out = R.duplicate_groups(_read(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"], F.struct("p_retailprice", (-F.col("p_partkey")).alias("k")), "p_partkey")
    return out.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "group_size", "is_primary")


@_query("""SELECT p_partkey, p_name, hits FROM (SELECT p_partkey, p_name, (contains(h, ' red '))::INT + (contains(h, ' ring '))::INT + (contains(h, ' economy '))::INT AS hits
 FROM (SELECT *, ' ' || lower(p_name) || ' ' || lower(p_type) || ' ' AS h FROM part)) WHERE hits >= 2""")
def keyword_search(spark, d):
    return R.search(_read(spark, d, "part"), ["p_name", "p_type"], "red ring economy").select("p_partkey", "p_name", "hits")


@_query("""SELECT a.s_suppkey AS l, b.s_suppkey AS r, 10.0::DOUBLE * (a.s_nationkey = b.s_nationkey)::INT + 5.0::DOUBLE * (floor(a.s_acctbal / 100) = floor(b.s_acctbal / 100))::INT AS weight
 FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND (a.s_nationkey = b.s_nationkey OR floor(a.s_acctbal / 100) = floor(b.s_acctbal / 100))
 QUALIFY row_number() OVER (PARTITION BY l ORDER BY weight DESC, r) <= 5""")
def blocking_candidates(spark, d):
    keys = R.block(_read(spark, d, "supplier"), "s_suppkey", {"nation": F.col("s_nationkey").cast("string"), "balance": F.floor(F.col("s_acctbal") / 100).cast("string")})
    return R.candidates(keys, keys, {"nation": 10, "balance": 5}, top=5)


@_query("SELECT p_type, p_brand, count(*) AS n, count(DISTINCT p_name) AS names, sum((p_size > 25)::INT)::BIGINT AS large, max(p_retailprice) AS top_price FROM part GROUP BY ALL")
def group_counts(spark, d):
    return _read(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("names"), F.count_if(F.col("p_size") > 25).alias("large"), F.max("p_retailprice").alias("top_price"))


@_query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def unmatched_products(spark, d):
    """Products that were never sold fifty at once; the whole of both tables."""
    large = _read(spark, d, "lineitem").where("l_quantity >= 50")
    return R.not_in(_read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", large, "l_partkey")


@_query("""SELECT x.id FROM (SELECT 1 AS id, 5 AS v UNION ALL SELECT 2, NULL UNION ALL SELECT 3, 6) x WHERE v NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey = 5)
 UNION ALL SELECT x.id + 10 FROM (SELECT 1 AS id, 5 AS v UNION ALL SELECT 2, NULL UNION ALL SELECT 3, 6) x WHERE v NOT IN (SELECT CASE WHEN s_nationkey = 5 THEN NULL ELSE 5 END FROM supplier)
 UNION ALL SELECT x.id + 20 FROM (SELECT 1 AS id, 5 AS v UNION ALL SELECT 2, NULL UNION ALL SELECT 3, 6) x WHERE v NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 0)""")
def not_in_nulls(spark, d):
    """NOT IN against a list without nulls, with one, and an empty one."""
    x = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id int, v long")
    s = _read(spark, d, "supplier")
    parts = [s.where("s_nationkey = 5").select("s_nationkey"), s.select(F.when(F.col("s_nationkey") != 5, 5).alias("s_nationkey")), s.where("s_nationkey < 0").select("s_nationkey")]
    out = [R.not_in(x, "v", p, "s_nationkey").select((F.col("id") + 10 * k).alias("id")) for k, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("""SELECT c_custkey, c_name, n_name, r_name, coalesce(n, 0) AS orders, round(coalesce(v, 0), 2) AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def master_export(spark, d):
    o = _read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    c = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("v", F.lit(0.0)), 2).alias("value"))


@_query("""SELECT lpad(rank::VARCHAR, 6, '0') AS no, 'ENT-' || lpad(rank::VARCHAR, 6, '0') AS entity_id, p_name, records FROM (
 SELECT p_name, count(*) AS records, row_number() OVER (ORDER BY p_name) AS rank FROM part GROUP BY p_name)""")
def entity_numbers(spark, d):
    names = _read(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("records"))
    return O.numbered(names, "p_name", "ENT-", checkpointer(spark, "numbers")).select("no", "entity_id", "p_name", "records")


@_query("""SELECT doc_id, passage_no, passage FROM (SELECT doc_id, s // 1000 AS passage_no, substr(text, s::BIGINT + 1, 1200) AS passage
 FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS s FROM documents))""")
def document_passages(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.posexplode(T.passages(F.col("text"))).alias("passage_no", "passage")).withColumn("passage_no", F.col("passage_no").cast("long"))


@_query("""SELECT doc_id, sha256(text) AS content_hash, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents""")
def content_identity(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    groups = docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return docs.join(groups, "content_hash").select("doc_id", "content_hash", "copies", "first_id")


@_query("""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,}'), lambda e: NOT contains(e, '..'))))::VARCHAR[] AS emails
 FROM documents WHERE contains(text, '@')""")
def contact_emails(spark, d):
    return _read(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.array_sort(T.emails(F.col("text"))).alias("emails"))


@_query("SELECT o_orderpriority, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1")
def status_report(spark, d):
    g = _read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@_query("""SELECT 'supplier' AS kind, s_suppkey AS key, s_nationkey AS nation FROM supplier WHERE s_acctbal < 0 UNION SELECT 'customer', c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0""")
def quality_issues(spark, d):
    s = _read(spark, d, "supplier").where("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    c = _read(spark, d, "customer").where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return s.unionByName(c).distinct()


_LCS = """list_reduce(list_concat([list_transform(range(length(b) + 1), lambda x: 0::BIGINT)], list_transform(range(1, length(a) + 1), lambda i: [i::BIGINT])),
 lambda p, q: list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN substr(a, q[1], 1) = substr(b, j::BIGINT, 1) THEN p[j] + 1 ELSE p[j + 1] END])), lambda s, t: list_append(s, greatest(s[len(s)], t[1]))))[length(b) + 1]"""


def _ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {_LCS.replace('length(a)', f'length({a})').replace('length(b)', f'length({b})').replace('substr(a,', f'substr({a},').replace('substr(b,', f'substr({b},')} / (length({a}) + length({b})) END)"


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
_PACKED = "replace({}, ' ', '')"


@_query(f"""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM n),
 p AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM w x JOIN w y USING (w) WHERE x.p_name < y.p_name),
 s AS (SELECT a, b, {_SORTED.format('a')} AS sa, {_SORTED.format('b')} AS sb, {_PACKED.format('a')} AS pa, {_PACKED.format('b')} AS pb FROM p),
 r AS (SELECT a, b, round(least(CASE WHEN list_max(list_transform(string_split(a || ' ' || b, ' '), lambda x: length(x))) <= 4 THEN 70.0::DOUBLE ELSE 99.0::DOUBLE END, greatest({_ratio_sql('sa', 'sb')}, {_ratio_sql('pa', 'pb')})), 1) AS score FROM s)
 SELECT a, b, score, CASE WHEN score >= 95 THEN 'Very High' WHEN score >= 85 THEN 'High' WHEN score >= 70 THEN 'Possible Match' WHEN score >= 50 THEN 'Manual Review' ELSE 'Probably Different' END AS band FROM r WHERE score >= 50""")
def name_links(spark, d):
    """Distinct part names that share a word, by similarity; names are a dimension."""
    names = _read(spark, d, "part").select("p_name").distinct()
    words = names.select("p_name", F.explode(F.array_distinct(T.tokens(F.col("p_name")))).alias("word"))
    pairs = words.alias("a").join(words.alias("b"), "word").where("a.p_name < b.p_name").select(F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b")).distinct()
    plain = Words(generic=(), distinguishing=(), titles=(), contextual={}, places=())
    return pairs.withColumn("score", F.round(L.similarity(F.col("a"), F.col("b"), plain), 1)).withColumn("band", R.band(F.col("score"))).where("score >= 50")


def _load() -> None:
    """Register the queries of the other modules of this package."""
    from tidemark.plans import admin, assist, cleaning, extended, mapping, products  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
